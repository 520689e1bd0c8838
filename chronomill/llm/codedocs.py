"""Functions paired with their documentation: symbol tables of source files, joined to code-description pairs.

A symbol table row has the qualified name (enclosing classes and functions joined by dots), the normalised
signature with and without types, whether it is a mere declaration (an overload, a body without code, anything in
a file of declarations), its documentation and its code. Files are parsed where they are read, each content once a
task, so contents are never shuffled. Every definition is then joined with the documentation it points to: its own or,
without one, that of the declarations of the same qualified name and signature in the task's files of that side.
A definition without types takes each overload with its parameter names, one pair for each; one with types only that
of the same types. Of several declarations with one signature the first path counts. Empty and trivial documentation
is dropped last.

Python: ``def`` and ``async def`` at any depth, from the syntax tree; a file that does not parse as Python 3
gives nothing. JavaScript: ``function`` declarations and class methods, from a tokeniser that knows strings,
templates, regular expressions and comments. Files of declarations are ``.pyi`` and ``.d.ts``. Documentation is the
docstring or, without one, the comment that ends on the line right above the function and its decorators.

Trivial documentation has fewer than five words, TODO, FIXME or TBD as first word, or no word but those of
the function's own name. Defined cases: null maps, contents and paths give nothing; repeated rows of a task
come out once; a name defined twice in a file is one function for ``found``; a byte order mark is dropped;
line ends of any kind count as one.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomill.common import cut
from chronomill.llm.words import words

LEAST_WORDS = 5
# First words that mark documentation still to be written.
PLACEHOLDERS = ("todo", "fixme", "tbd")
SOURCES, DECLARATIONS = (".py", ".js"), (".pyi", ".d.ts")
_MEMO_CHARS = 20_000_000


class Symbol(NamedTuple):
    name: str
    shape: str  # names of the parameters
    signature: str  # and their types, where there are any
    declared_only: bool
    doc: str | None
    code: str


def is_trivial(doc: str | None, name: str) -> bool:
    ws = words(doc)
    own = set(words(name.rpartition(".")[2]))
    return len(ws) < LEAST_WORDS or ws[0] in PLACEHOLDERS or own.issuperset(ws)


def _unix(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def _strings(tree: ast.AST) -> list[tuple[int, int]]:
    """Spans of lines that begin inside a string."""
    nodes = (n for n in ast.walk(tree) if isinstance(n, (ast.Constant, ast.JoinedStr)) and n.end_lineno > n.lineno)
    return [(n.lineno + 1, n.end_lineno) for n in nodes if isinstance(n, ast.JoinedStr) or isinstance(n.value, (str, bytes))]


def _above(lines: list[str], line: int, strings: Callable[[], list[tuple[int, int]]]) -> str | None:
    """The comment whose last line is right above a line; lines within strings are none."""
    first = line
    while first > 1 and lines[first - 2].lstrip().startswith("#"):
        first -= 1
    if first == line:
        return None
    # A string that ends within these lines shows its closing quotes there.
    quoted = any('"' in x or "'" in x for x in lines[first - 1 : line - 1])
    inside = [end for begin, end in strings() if begin <= line - 1 and end >= first] if quoted else []
    first = max([first, *(end + 1 for end in inside)])
    return "\n".join(x.lstrip().lstrip("#") for x in lines[first - 1 : line - 1]) if first < line else None


_BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")


def _statements(node: ast.AST) -> Iterator[ast.AST]:
    """Statements right inside a node, where definitions can stand."""
    for part in _BLOCKS:
        if part in node._fields:
            yield from getattr(node, part)


def _py_signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[str, str]:
    """Names of the parameters, and names with types."""
    a = node.args
    marked = [("", x) for x in (*a.posonlyargs, *a.args)]
    marked += [("*", a.vararg)] if a.vararg else [("*", None)] if a.kwonlyargs else []
    marked += [("", x) for x in a.kwonlyargs] + ([("**", a.kwarg)] if a.kwarg else [])
    if marked and marked[0][1] is not None and marked[0][1].arg in ("self", "cls"):
        del marked[0]
    names = [m + (x.arg if x else "") for m, x in marked]
    typed = [n + (f":{ast.unparse(x.annotation)}" if x is not None and x.annotation is not None else "") for n, (_, x) in zip(names, marked, strict=True)]
    return ",".join(names), "".join(c for c in ",".join(typed) if c not in " \"'")


def _is_stub(node: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    if any((d.attr if isinstance(d, ast.Attribute) else getattr(d, "id", "")) == "overload" for d in node.decorator_list):
        return True
    return all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) for s in node.body)


def python_symbols(text: str, declarations: bool = False) -> list[Symbol]:
    if "def" not in text:
        return []
    text = _unix(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = text.split("\n")
    strings = functools.lru_cache(lambda: _strings(tree))
    out: list[Symbol] = []
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, inside = todo.pop()
        for kid in _statements(node):
            if not isinstance(kid, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if "body" in kid._fields or "cases" in kid._fields:
                    todo.append((kid, inside))
                continue
            name = f"{inside}.{kid.name}" if inside else kid.name
            todo.append((kid, name))
            if not isinstance(kid, ast.ClassDef):
                top = min([kid.lineno, *(d.lineno for d in kid.decorator_list)])
                doc = ast.get_docstring(kid)
                doc = _above(lines, top, strings) if doc is None else doc
                code = "\n".join(lines[top - 1 : kid.end_lineno])
                out.append(Symbol(name, *_py_signature(kid), declarations or _is_stub(kid), doc, code))
    return out


class _Js(NamedTuple):
    kind: str  # 'name', 'mark' or 'value'
    text: str
    line: int
    at: int


# Words and marks after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void instanceof new do else throw yield await".split())
_NOT_METHODS = frozenset("if for while switch catch with function return super new typeof await yield".split())


def _js_tokens(text: str) -> tuple[list[_Js], dict[int, tuple[int, str]]]:
    """Tokens, and comments standing alone on their lines: last line to (first line, text)."""
    out: list[_Js] = []
    comments: dict[int, tuple[int, str]] = {}
    i, line, n = 0, 1, len(text)
    templates: list[int] = []
    depth = 0
    fresh = True  # nothing but white space and comments so far on this line
    while i < n:
        c = text[i]
        if c == "\n":
            line, i, fresh = line + 1, i + 1, True
        elif c.isspace():
            i += 1
        elif text.startswith("//", i) or i == 0 and text.startswith("#!"):
            end = text.find("\n", i)
            end = n if end < 0 else end
            if fresh:
                comments[line] = (line, text[i + 2 : end])
            i = end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            body = text[i:end]
            last = line + body.count("\n")
            rest = text.find("\n", end)
            tail = text[end : n if rest < 0 else rest].strip()
            if fresh and (not tail or tail.startswith(("//", "/*"))):
                comments[last] = (line, body[2:-2])
            line, i = last, end
        elif c in "\"'":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            j = min(j, n)
            out.append(_Js("value", text[i + 1 : j], line, i))
            line += text.count("\n", i, min(j, n))
            i, fresh = j + (j < n and text[j] == c), False
        elif c == "`" or c == "}" and templates and templates[-1] == depth:
            if c == "}":
                templates.pop()
            j, begun = i + 1, line
            while j < n and text[j] != "`" and not text.startswith("${", j):
                line += text[j] == "\n" or text[j] == "\\" and text[j + 1 : j + 2] == "\n"
                j += 2 if text[j] == "\\" else 1
            if text.startswith("${", j):
                templates.append(depth)
                j += 2
            else:
                j += 1
            out.append(_Js("value", "", begun, i))
            i, fresh = min(j, n), False
        elif c.isalnum() or c in "_$#@\\":
            j = i + 1
            while j < n and (text[j].isalnum() or text[j] in "_$‌‍"):
                j += 1
            out.append(_Js("value" if c.isdigit() else "name", text[i:j], line, i))
            i, fresh = j, False
        elif c == "/" and (not out or out[-1].kind == "mark" and out[-1].text not in ")]}" or out[-1].text in _BEFORE_REGEX):
            j, group = i + 1, False
            while j < n and text[j] != "\n" and (group or text[j] != "/"):
                group = text[j] == "[" or group and text[j] != "]"
                j += 2 if text[j] == "\\" else 1
            out.append(_Js("value", "", line, i))
            i, fresh = min(j + 1, n), False
        else:
            mark = "=>" if text.startswith("=>", i) else c
            depth += (c == "{") - (c == "}")
            out.append(_Js("mark", mark, line, i))
            i, fresh = i + len(mark), False
    return out, comments


def _closing(tokens: list[_Js]) -> dict[int, int]:
    """Index of the closing bracket of each opening one."""
    pairs, stack = {}, []
    for k, t in enumerate(tokens):
        if t.kind == "mark" and t.text in "([{":
            stack.append(k)
        elif t.kind == "mark" and t.text in ")]}" and stack:
            pairs[stack.pop()] = k
    return pairs


def javascript_symbols(text: str, declarations: bool = False) -> list[Symbol]:
    text = _unix(text)
    toks, comments = _js_tokens(text)
    close, n = _closing(toks), len(toks)
    opens = {b: a for a, b in close.items()}
    out: list[Symbol] = []

    def is_(k: int, *marks: str) -> bool:
        return 0 <= k < n and toks[k].kind == "mark" and toks[k].text in marks

    def word(k: int, *names: str) -> bool:
        return 0 <= k < n and toks[k].kind == "name" and (not names or toks[k].text in names)

    def doc_above(k: int) -> str | None:
        line = toks[k].line
        if any(t.line == line for t in toks[max(0, k - 1) : k]):
            return None
        parts: list[str] = []
        at = line - 1
        while at in comments:
            first, body = comments[at]
            parts.append(body)
            at = first - 1
            if body.startswith("*") or "\n" in body:
                break
        return "\n".join(reversed(parts)) if parts else None

    def add(name: str, first: int, open_: int, end: int | None) -> None:
        args, body_end = close.get(open_, n - 1), end
        names, typed, k = [], [], open_ + 1
        while k < args:  # one parameter, up to the next comma outside of brackets
            parts, angles = [], 0
            while k < args and (angles > 0 or not is_(k, ",")):
                angles += is_(k, "<") - is_(k, ">") if declarations else 0
                parts += [t.text for t in toks[k : close.get(k, k) + 1]]
                k = close.get(k, k) + 1
            k += 1
            own = next((x for x in parts if x != "."), "")
            names.append(own if parts[:1] != ["."] else f"...{own}")
            kind = "".join(parts[parts.index(":") + 1 :]).partition("=")[0] if ":" in parts and own not in ("{", "[") else ""
            typed.append(names[-1] + (f":{kind}" if kind else ""))
        stop = toks[body_end].at + 1 if body_end is not None else toks[args].at + 1
        out.append(Symbol(name, ",".join(names), ",".join(typed), declarations or body_end is None, doc_above(first), text[toks[first].at : stop]))

    def body_of(open_: int) -> int | None:
        """Index of the brace that opens the body of the function whose parameters open at ``open_``."""
        k = close.get(open_, n) + 1
        while k < n and not is_(k, "{", ";", "}", ","):
            k += 1
        return k if is_(k, "{") and k in close else None

    # Spans to visit: (first token, end token, enclosing name, whether it is a class body).
    spans = [(0, n, "", False)]
    while spans:
        k, end, inside, in_class = spans.pop()
        while k < end:
            if word(k, "class") and not is_(k - 1, ".") and not is_(k + 1, ":", ",", "(", "="):
                name = toks[k + 1].text if word(k + 1) and not word(k + 1, "extends") else ""
                b = k + 1
                while b < end and not is_(b, "{"):
                    b = close.get(b, b) + 1
                if b < end and b in close:
                    spans.append((b + 1, close[b], f"{inside}.{name}".strip("."), True))
                    k = close[b] + 1
                    continue
            elif word(k, "function") and not is_(k - 1, "."):
                j = k + 1 + is_(k + 1, "*")
                if word(j) and is_(j + 1, "("):
                    first = k - word(k - 1, "async")
                    expr = first > 0 and (
                        is_(first - 1, "=", "(", ",", ":", "?", "[", "&", "|", "!", "+", "-", "=>", "~")
                        or word(first - 1, "return", "new", "typeof", "void", "await", "yield", "throw", "in", "of")
                    )
                    while word(first - 1, "export", "default", "declare"):
                        first -= 1
                    body = body_of(j + 1)
                    name = f"{inside}.{toks[j].text}".strip(".")
                    if not expr:
                        add(name, first, j + 1, close[body] if body is not None else None)
                    if body is not None:
                        spans.append((body + 1, close[body], name, False))
                        k = close[body] + 1
                        continue
            elif in_class and is_(k, "("):
                name_at = k - 1
                own = name_at >= 0 and (toks[name_at].kind == "name" or toks[name_at].kind == "value" and toks[name_at].text)
                body = body_of(k)
                declared = declarations and (is_(close.get(k, n) + 1, ":", ";") or toks[min(close.get(k, n) + 1, n - 1)].line > toks[min(close.get(k, n), n - 1)].line)
                if declared and own and toks[name_at].text not in _NOT_METHODS:
                    first = name_at
                    while word(first - 1, "static", "get", "set", "public", "private", "protected", "abstract", "readonly"):
                        first -= 1
                    add(f"{inside}.{toks[name_at].text}".strip("."), first, k, None)
                    k = close.get(k, k) + 1
                    continue
                if own and toks[name_at].text not in _NOT_METHODS and body is not None and is_(close[k] + 1, "{") or own and body is not None and is_(close.get(k, n) + 1, ":"):
                    first = name_at - is_(name_at - 1, "*")
                    while word(first - 1, "async", "static", "get", "set", "public", "private", "protected", "override", "readonly"):
                        first -= 1
                    decorator = lambda q: word(q) and toks[q].text.startswith("@")
                    while decorator(first - 1) or is_(first - 1, ")") and decorator(opens.get(first - 1, 0) - 1):
                        first = opens.get(first - 1, first) - 1 if is_(first - 1, ")") else first - 1
                    name = f"{inside}.{toks[name_at].text.lstrip('#')}".strip(".")
                    add(name, first, k, close[body])
                    spans.append((body + 1, close[body], name, False))
                    k = close[body] + 1
                    continue
                k = close.get(k, k) + 1
                continue
            elif in_class and is_(k, "=", "{", "["):
                # A field's value or a static block: what it declares is not a method of the class.
                stop = close.get(k, k) if not is_(k, "=") else k + 1
                if is_(k, "="):
                    while stop < end and not is_(stop, ";") and (toks[stop].line == toks[stop - 1].line or is_(stop - 1, "=", "=>", "(", ",", "+")):
                        stop = close.get(stop, stop) + 1
                spans.append((k + 1, stop, inside, False))
                k = max(stop, k + 1)
                continue
            k += 1
    return out


def symbols(path: str, text: str) -> list[Symbol]:
    if path.endswith((".py", ".pyi")):
        return python_symbols(text, path.endswith(".pyi"))
    return javascript_symbols(text, path.endswith(".d.ts")) if path.endswith((".js", ".d.ts")) else []


_TABLE = (
    "task_id string, side string, path string, function_name string, signature string, shape string, declared_only boolean,"
    " documented boolean, place string, doc_key string, trivial boolean"
)


def _parsed(texts: bool) -> Callable:
    """Rows of the symbol table of each task; documentation and code only with ``texts``."""
    n_columns = 13 if texts else 11

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], tuple[str, list]] = {}
        size = 0
        for b in batches:
            rows = []
            tasks, *sides = (b.column(c).to_pylist() for c in range(3))
            for task, *files in zip(tasks, *sides, strict=True):
                for side, entries in zip(("initial", "transition"), files, strict=True):
                    for path, text in entries or ():
                        suffix = next((x for x in SOURCES + DECLARATIONS if path and path.endswith(x)), None)
                        if text is None or suffix is None:
                            continue
                        if (suffix, text) not in memo:
                            if size > _MEMO_CHARS:
                                memo, size = {}, 0
                            size += len(text)
                            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
                            found = [(s, s.doc is not None and is_trivial(s.doc, s.name)) for s in symbols(suffix, text)]
                            memo[suffix, text] = digest, found
                        digest, found = memo[suffix, text]
                        for k, (s, trivial) in enumerate(found):
                            # A documented symbol points to its own place, another one to what is declared elsewhere.
                            place = f"{path}#{digest}#{k}"
                            key = place if s.doc is not None or s.declared_only else f"{s.name}({s.signature})"
                            rows.append((task, side, path, s.name, s.signature, s.shape, s.declared_only, s.doc is not None, place, key, trivial, s.doc, s.code)[:n_columns])
            types = [*[pa.string()] * 6, pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()][:n_columns]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            names = [*(f.split()[0] for f in _TABLE.split(",")), "doc", "code"][:n_columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def symbol_table(tasks: DataFrame, texts: bool = True) -> DataFrame:
    """(task_id, side, path, function_name, signature, ..., doc, code) of every function."""
    return tasks.select("task_id", "initial_workspace", "workspace_transition").mapInArrow(_parsed(texts), _TABLE + (", doc string, code string" if texts else ""))


def resolved(tasks: DataFrame, texts: bool = True) -> DataFrame:
    """Definitions joined with the documentation they point to: their own (``is_own``) or a declaration's.

    A documented symbol can be pointed to by its place, a documented declaration also by its name and signature and
    by its name and the names of its parameters.
    """
    table = cut(symbol_table(tasks, texts))
    named = lambda c: F.concat("function_name", F.lit("("), c, F.lit(")"))
    keys = F.when(F.col("declared_only"), F.array_distinct(F.array("place", named("signature"), named("shape")))).otherwise(F.array("place"))
    found = F.struct("path", "place", "trivial", *(["doc"] if texts else []))
    docs = (
        table.where("documented")
        .select("task_id", "side", F.explode(keys).alias("doc_key"), F.col("signature").alias("doc_signature"), found.alias("_d"))
        .groupBy("task_id", "side", "doc_key", "doc_signature")
        .agg(F.min("_d").alias("_d"))
    )
    joined = table.drop("doc", "trivial", "documented", "declared_only").join(docs, ["task_id", "side", "doc_key"])
    return joined.select("*", F.col("_d.path").alias("doc_path"), (F.col("_d.place") == F.col("place")).alias("is_own"), *[F.col(f"_d.{c}") for c in ("trivial", "doc")[: 1 + texts]])


def pairs(tasks: DataFrame) -> DataFrame:
    """(task_id, side, path, function_name, signature, doc, doc_path, code): functions with documentation that says something."""
    said = resolved(tasks).where("not trivial").dropDuplicates(["task_id", "side", "place", "doc_signature"])
    return said.select("task_id", "side", "path", "function_name", "signature", "doc", "doc_path", "code")


def found(tasks: DataFrame) -> DataFrame:
    """(task_id, side, path, function_name) of the functions of source files that are documented where they stand."""
    here = F.col("is_own") & (F.endswith("path", F.lit(SOURCES[0])) | F.endswith("path", F.lit(SOURCES[1])))
    return resolved(tasks, texts=False).where(~F.col("trivial") & here).select("task_id", "side", "path", "function_name").distinct()
