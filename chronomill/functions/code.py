"""Facts of Python sources as tables, and the relational questions asked of them.

A source is parsed once, in Arrow batches, into plain rows: what it defines, imports, uses and says. Digest
comparison, API differences, symbol resolution, deprecated use and solution overlap are then joins and
aggregates over those rows.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomill.common import cut
from chronomill.functions import text as tx

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(source: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def digest(node: ast.AST) -> str:
    """Digest of a syntax tree without positions: equal for code that differs in layout and comments only."""
    return hashlib.sha256(ast.dump(node).encode()).hexdigest()


def _targets(node: ast.AST) -> list[str]:
    return [t.id for t in node.targets if isinstance(t, ast.Name)] if isinstance(node, ast.Assign) else []


def digests(source: str | None) -> list[tuple]:
    """(qualified_name, symbol_name, symbol_type, symbol_digest, lineno) of a module's and its classes' symbols.

    Functions, classes and plain assignments of the module, methods and plain assignments of its classes. Of
    equal names the last counts. A source that does not parse has none.
    """
    found: dict[str, tuple] = {}

    def note(node: ast.AST, owner: str) -> None:
        if isinstance(node, _FUNCTIONS):
            named = [(node.name, "method" if owner else "function")]
        elif isinstance(node, ast.ClassDef) and not owner:
            named = [(node.name, "class")]
        else:
            named = [(n, "assignment") for n in _targets(node)]
        for name, kind in named:
            full = f"{owner}.{name}" if owner else name
            found[full] = (full, name, kind, digest(node), node.lineno)

    for node in (tree := parse(source)) and tree.body or []:
        note(node, "")
        for item in node.body if isinstance(node, ast.ClassDef) else []:
            note(item, node.name)
    return list(found.values())


def _warns(node: ast.AST) -> bool:
    calls = (c.func for c in ast.walk(node) if isinstance(c, ast.Call))
    names = (f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "" for f in calls)
    return any("warn" in n.lower() or "deprecated" in n.lower() for n in names)


def signature(args: ast.arguments) -> str:
    """Parameters in order with their kinds and defaults, without types."""
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + args.defaults
    shown = lambda a, d: a.arg if d is None else f"{a.arg}={ast.unparse(d)}"
    out = [shown(a, d) for a, d in zip(plain, defaults, strict=True)]
    if args.posonlyargs:
        out.insert(len(args.posonlyargs), "/")
    out += [f"*{args.vararg.arg}"] if args.vararg else ["*"] if args.kwonlyargs else []
    out += [shown(a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    return ", ".join([*out, *([f"**{args.kwarg.arg}"] if args.kwarg else [])])


def definitions(source: str | None) -> list[tuple]:
    """(qualified_name, kind, signature, deprecated, lineno) of everything a source defines, at any depth.

    Kinds: function, class, assignment, attribute, parameter, and hook for names that a module or class
    ``__getattr__`` answers to.
    """
    out: list[tuple] = []

    def visit(node: ast.AST, owner: str) -> None:
        for kid in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(kid, (*_FUNCTIONS, ast.ClassDef)):
                inner = f"{owner}.{kid.name}" if owner else kid.name
                told = "deprecat" in (ast.get_docstring(kid) or "").lower()
                if isinstance(kid, ast.ClassDef):
                    out.append((inner, "class", None, told, kid.lineno))
                else:
                    args = kid.args
                    out.append((inner, "function", signature(args), told or _warns(kid), kid.lineno))
                    for a in (*args.posonlyargs, *args.args, *args.kwonlyargs):
                        out.append((f"{inner}.{a.arg}", "parameter", None, False, kid.lineno))
                    if kid.name == "__getattr__":
                        for c in ast.walk(kid):
                            if isinstance(c, ast.Compare):
                                for s in ast.walk(c):
                                    if isinstance(s, ast.Constant) and isinstance(s.value, str):
                                        out.append((f"{owner}.{s.value}".strip("."), "hook", None, _warns(kid), c.lineno))
            elif isinstance(kid, (ast.Assign, ast.AnnAssign)):
                for t in kid.targets if isinstance(kid, ast.Assign) else [kid.target]:
                    if isinstance(t, ast.Name):
                        out.append((f"{owner}.{t.id}".strip("."), "assignment", None, False, kid.lineno))
                    elif isinstance(t, ast.Attribute):
                        out.append((f"{owner}.{t.attr}".strip("."), "attribute", None, False, kid.lineno))
            visit(kid, inner)

    if (tree := parse(source)) is not None:
        visit(tree, "")
    return out


def _chain(node: ast.AST) -> list[str]:
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [*([node.id] if isinstance(node, ast.Name) else []), *reversed(parts)]


_IMPORT_LINE = re.compile(r"^\s*(?:from\s+(\S+)\s+import\s+(.*)|import\s+(.*))$", re.MULTILINE)


_ASSIGN_LINE = re.compile(r"^\s*([\w.]+)\s*=(?!=)", re.MULTILINE)
_SUBSCRIPT = re.compile(r"""\[['"]([^'"\n]*)['"]\]""")


def facts(source: str | None) -> list[tuple]:
    """(kind, name, value, lineno) of what a source imports, uses and says.

    import: full dotted name. use: dotted name with import aliases resolved. raw: attribute chain as written.
    lookup: object and name of a ``getattr`` with a literal name. keyword: argument name, its literal as value
    (``<empty>`` for an empty collection). name, define: a name that is read, written or defined. literal: a constant
    that is no docstring, as value. text: a comment or docstring. A source that does not parse gives imports of its
    import lines, names that its lines assign, literals of its subscripts, and comments.
    """
    source = source or ""
    tree = parse(source)
    out: list[tuple] = []
    if tree is None:
        for m in _IMPORT_LINE.finditer(source):
            names = [x.split(" as ")[0].strip(" ()\\\r") for x in (m[2] or m[3]).split(",")]
            out += [("import", f"{m[1]}.{n}" if m[1] else n, None, 0) for n in names if n]
        out += [("name", m[1], None, 0) for m in _ASSIGN_LINE.finditer(source)] + [("literal", None, m[1], 0) for m in _SUBSCRIPT.finditer(source)]
        return out + [("text", None, x, k) for k, x in enumerate(source.split("\n"), 1) if x.strip().startswith("#")]
    alias: dict[str, str] = {}
    own = {n.name for n in ast.walk(tree) if isinstance(n, (*_FUNCTIONS, ast.ClassDef))}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out.append(("import", a.name, None, n.lineno))
                alias[a.asname or a.name] = a.name
                out += [("name", a.asname, None, n.lineno)] if a.asname else []
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                full = f"{n.module}.{a.name}" if n.module else a.name
                out.append(("import", full, None, n.lineno))
                alias[a.asname or a.name] = full
                out += [("name", a.asname, None, n.lineno)] if a.asname else []
    told = {id(n.body[0].value) for n in ast.walk(tree) if isinstance(n, (ast.Module, *_FUNCTIONS, ast.ClassDef)) and n.body and isinstance(n.body[0], ast.Expr)}
    for n in ast.walk(tree):
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            out.append(("define", n.name, None, n.lineno))
        elif isinstance(n, ast.Name):
            out.append(("name", n.id, None, n.lineno))
        elif isinstance(n, ast.Constant) and not (id(n) in told and isinstance(n.value, str)):
            out.append(("literal", None, str(n.value), n.lineno))
        if isinstance(n, (ast.Attribute, ast.Name)):
            parts = _chain(n)
            if isinstance(n, ast.Attribute):
                out.append(("raw", ".".join(parts), n.attr, n.lineno))
            for k in range(len(parts), 0, -1):
                head = ".".join(parts[:k])
                if head in alias and (k > 1 or head not in own):
                    out.append(("use", ".".join([alias[head], *parts[k:]]), None, n.lineno))
                    break
        elif isinstance(n, ast.Call):
            f, args = n.func, n.args
            if isinstance(f, ast.Name) and f.id == "getattr" and len(args) > 1 and isinstance(args[1], ast.Constant) and isinstance(args[1].value, str):
                base = ".".join(_chain(args[0]))
                out.append(("lookup", ".".join(x for x in (alias.get(base, base), args[1].value) if x), args[1].value, n.lineno))
            for kw in n.keywords:
                if kw.arg:
                    v = kw.value
                    empty = isinstance(v, (ast.List, ast.Tuple, ast.Set)) and not v.elts or (
                        isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id in ("set", "list", "tuple") and not v.args
                    )
                    out.append(("keyword", kw.arg, "<empty>" if empty else repr(v.value) if isinstance(v, ast.Constant) else None, n.lineno))
        elif isinstance(n, (ast.Module, *_FUNCTIONS, ast.ClassDef)) and (doc := ast.get_docstring(n)):
            out.append(("text", None, doc, getattr(n, "lineno", 1)))
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                out.append(("text", None, t.string, t.start[0]))
    except (tokenize.TokenError, SyntaxError):
        pass
    return out


def bodies(source: str | None) -> list[tuple]:
    """(function_name, body) of functions with at least two statements besides documentation, white space normalised."""
    out = []
    for n in ast.walk(tree) if (tree := parse(source)) is not None else []:
        if isinstance(n, _FUNCTIONS):
            steps = [ast.unparse(s) for s in n.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
            body = " ".join(" ".join(steps).split())
            if len(steps) > 1 and len(body) > 30:
                out.append((n.name, body))
    return out


def _exploded(df: DataFrame, key: str, source: str, rows_of: Callable, schema: str) -> DataFrame:
    """(key, *schema): rows of each source. Equal sources of one batch are parsed once."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]
    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [arrow[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict = {}
            at, rows = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                if s not in seen:
                    seen[s] = rows_of(s)
                at += [i] * len(seen[s])
                rows += seen[s]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [key, *names])

    return df.select(key, source).mapInArrow(run, f"{key} {kind}, {schema}")


def symbol_digests(df: DataFrame, key: str, source: str) -> DataFrame:
    return _exploded(df, key, source, digests, "qualified_name string, symbol_name string, symbol_type string, symbol_digest string, lineno int")


def symbol_definitions(df: DataFrame, key: str, source: str) -> DataFrame:
    return _exploded(df, key, source, definitions, "qualified_name string, kind string, signature string, deprecated boolean, lineno int")


def source_facts(df: DataFrame, key: str, source: str) -> DataFrame:
    return _exploded(df, key, source, facts, "kind string, name string, value string, lineno int")


def function_bodies(df: DataFrame, key: str, source: str) -> DataFrame:
    return _exploded(df, key, source, bodies, "function_name string, body string")


def resolved(wanted: DataFrame, definitions_: DataFrame, key: str) -> DataFrame:
    """(key, symbol, n_found, resolution) of wanted (key, symbol): by qualified name or last part."""
    named = definitions_.withColumn("symbol", F.explode(F.array_distinct(F.array("qualified_name", tx.short_symbol("qualified_name")))))
    n = named.groupBy(key, "symbol").agg(F.countDistinct("qualified_name", "kind", "lineno").alias("n_found"))
    j = wanted.join(n, [key, "symbol"], "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    plain = F.col("symbol").rlike(r"^[A-Za-z_][\w.]*$")
    return j.withColumn(
        "resolution",
        F.when(F.col("n_found") == 1, "UNIQUE_PASS").when(F.col("n_found") > 1, "AMBIGUOUS_TARGET").when(~plain, "NON_AST_SYMBOL").otherwise("SYMBOL_NOT_FOUND"),
    )


def api_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, qualified_name, change): removed, added, signature or deprecated, between two definition tables."""
    pick = lambda d, s: d.where("kind in ('function', 'class')").groupBy(key, "qualified_name").agg(F.max_by(F.struct("kind", "signature", "deprecated"), "lineno").alias(s))
    j = pick(before, "_a").join(pick(after, "_b"), [key, "qualified_name"], "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a.kind") == "function") & (F.col("_b.kind") == "function")
    kinds = F.array(
        F.when(F.col("_b").isNull(), "removed"),
        F.when(F.col("_a").isNull(), "added"),
        F.when(both & (F.col("_a.signature") != F.col("_b.signature")), "signature"),
        F.when(F.col("_b.deprecated"), "deprecated"),
    )
    return j.select(key, "qualified_name", F.explode(F.filter(kinds, lambda c: c.isNotNull())).alias("change"))


def deprecated_use(snippets: DataFrame, key: str, source: str, symbols: str, keywords: str | None = None) -> DataFrame:
    """(key, active, mention, n_active): whether each snippet acts on deprecated symbols or only mentions them.

    ``symbols`` is an array of dotted or plain names, ``keywords`` an array of structs (name, value,
    value_type). A dotted name is used when it is imported (or a name of a related module is), reached
    through an alias, an attribute chain or a literal ``getattr``; a plain one as attribute or import only
    where no dotted names are given, and as keyword or in ``getattr`` always. Own definitions hide imports.
    """
    # The facts are asked three times and parsed once.
    f = cut(source_facts(snippets, key, source).where("kind not in ('name', 'define', 'literal')"))
    named = snippets.select(key, F.explode(F.transform(F.array_distinct(symbols), lambda s: F.trim(s))).alias("symbol")).where("symbol <> ''")
    dotted = F.contains("symbol", F.lit("."))
    any_dotted = named.groupBy(key).agg(F.bool_or(dotted).alias("_any"))
    named = named.join(any_dotted, key).withColumn("_short", tx.short_symbol("symbol"))
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    parts = F.slice(F.split("symbol", r"\."), 1, F.greatest(F.size(F.split("symbol", r"\.")) - 1, F.lit(0)))
    module = F.regexp_replace("name", r"\.?[^.]*$", "")
    j = f.where("kind in ('import', 'use', 'raw', 'lookup', 'keyword')").withColumn("_short", F.when(F.col("kind") == "keyword", F.col("name")).otherwise(short("name"))).join(named, [key, "_short"])
    kind = F.col("kind")
    hit = F.when(dotted, (F.col("name") == F.col("symbol")) & kind.isin("import", "use", "raw", "lookup") | (kind == "import") & F.exists(parts, lambda p: F.contains(module, p))).otherwise(
        kind.isin("keyword", "lookup") | kind.isin("raw", "import") & ~F.col("_any")
    )
    active = j.where(hit).select(key, "lineno", "kind")
    if keywords:
        k = snippets.select(key, F.explode(keywords).alias("_k")).select(key, F.col("_k.name").alias("name"), F.col("_k.value").alias("_value"), F.col("_k.value_type").alias("_type"))
        fits = F.when(F.col("_value").isNotNull(), F.col("value") == F.col("_value")).when(F.col("_type") == "empty_collection", F.col("value") == "<empty>").otherwise(True)
        active = active.unionByName(f.where("kind = 'keyword'").join(k, [key, "name"]).where(fits).select(key, "lineno", "kind"))
    said = f.where("kind = 'text'").join(named.select(key, "_short"), key).where(F.contains("value", F.col("_short"))).select(key).distinct()
    n = active.distinct().groupBy(key).agg(F.count("*").alias("n_active"))
    return (
        snippets.select(key)
        .join(n, key, "left")
        .join(said.withColumn("mention", F.lit(True)), key, "left")
        .select(key, F.coalesce(F.col("n_active") > 0, F.lit(False)).alias("active"), F.coalesce("mention", F.lit(False)).alias("mention"), F.coalesce("n_active", F.lit(0)).alias("n_active"))
    )


def stale_names(snippets: DataFrame, key: str, source: str, symbols: str) -> DataFrame:
    """(key, active, mention, n_active): whether each snippet acts on any of some names, however it is written.

    Names count as given and by their last part: imported (also under another name), read, written, defined, as
    attribute or keyword, and as a literal that is the name or, from three characters on, holds it (subscripts and
    comparisons included). Comments and docstrings only mention them.
    """
    f = cut(source_facts(snippets, key, source).where("kind not in ('use', 'lookup')"))
    given = snippets.select(key, F.explode(symbols).alias("s")).where("s is not null")
    last = F.element_at(F.split("s", r"\."), -1)
    named = given.select(key, F.explode(F.array_distinct(F.array("s", last))).alias("symbol")).where("symbol <> ''").distinct()
    short = F.when(F.col("kind") == "raw", F.col("value")).when(F.col("kind") == "import", F.element_at(F.split("name", r"\."), -1)).otherwise(F.col("name"))
    written = f.where("kind not in ('literal', 'text')").select(key, "lineno", "kind", F.explode(F.array_distinct(F.array(short, "name"))).alias("symbol"))
    by_name = written.join(named, [key, "symbol"]).select(key, "lineno", "kind", "symbol")
    holds = (F.col("value") == F.col("symbol")) | (F.length("symbol") >= 3) & F.contains("value", "symbol")
    said = f.where("kind in ('literal', 'text')").join(named, key).where(F.when(F.col("kind") == "text", F.contains("value", "symbol")).otherwise(holds))
    by_literal = said.where("kind = 'literal'").select(key, "lineno", "kind", "symbol")
    n = by_name.unionByName(by_literal).distinct().groupBy(key).agg(F.count("*").alias("n_active"))
    mention = said.where("kind = 'text'").select(key, F.lit(True).alias("mention")).distinct()
    j = snippets.select(key).join(n, key, "left").join(mention, key, "left")
    return j.select(key, (F.coalesce("n_active", F.lit(0)) > 0).alias("active"), F.coalesce("mention", F.lit(False)).alias("mention"), F.coalesce("n_active", F.lit(0)).alias("n_active"))


def solution_overlap(contexts: DataFrame, solutions: DataFrame, key: str) -> DataFrame:
    """(key, near_solution): whether a context holds the body of any function of the key's solution."""
    b = function_bodies(solutions, key, "solution")
    hit = contexts.select(key, tx.normal_space("context").alias("_c")).join(b, key).where(F.contains("_c", F.col("body"))).select(key).distinct()
    return contexts.select(key).join(hit.withColumn("near_solution", F.lit(True)), key, "left").select(key, F.coalesce("near_solution", F.lit(False)).alias("near_solution"))
