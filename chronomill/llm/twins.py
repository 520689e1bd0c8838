"""Records hidden behind formatting: Merkle digests of normalised, partly unordered structures.

A statement is read bottom-up. Its leaves are word sequences without case (a word is a maximal run of
letters or digits). A statement made only of name-value fields is an unordered node: the digests of its fields are
sorted before they are hashed. Notations are JSON; two or more fields with ``:``, ``=`` or an arrow between separators
or line breaks, names of any number of words; fields of one-word names parted by white space alone (``a=1 b=2``,
``a: 1 b: 2``); elements of markup; tables of a head and one row or of rows of a name and a value. Values may be JSON in
any of them. A name has a letter, so clock times and ratios are no fields. JSON objects are unordered nodes at any
depth, arrays ordered ones. Every other statement is one leaf.

Records are grouped by root digest, and group keys also hold the full canonical form, so equal digests of
different structures stay apart. Statements with the same words belong together even if one of them reads
as fields and another does not (or they split into fields differently); such digests are joined first.

Defined cases: null statements and statements without a word have no twins; values may be empty; repeated
names are kept as often as they occur; an id with several statements is a member of each one's group; two
tables are never mixed; repeated rows of one id count as one copy (``n_rows`` counts them).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomill.common import cut
from chronomill.llm.words import WORD, words

_MARK = r"(?:->|=>|:=|[=：＝]|:(?!//))"
_FIELD = re.compile(rf"\s*([^:=：＝]*?)\s*{_MARK}(.*)", re.DOTALL)
_CUTS = tuple(re.compile(p) for p in (r"[;|\n\r；]", r"[;|；]", r"[;|\n\r；,，]", r"[;|；,，]"))
# One-word names parted by white space alone, with marks of one kind.
_NEXT = tuple(re.compile(rf"(?:^|(?<=[\s;|,；，]))[^\s\w]*([^\W\d][\w.\-]*)[^\s\w:=]?\s*{m}") for m in (r"(?<![<>!=])=(?![=>])", r":(?=\s)"))
_INNER = re.compile(r"[^\W\d][\w.\-]*\s*(?<![<>!=])=(?![=>])")
_QUOTED = re.compile(r'(?<=[:=：＝])\s*"(?:[^"\\\n]|\\.)*"(?=\s|[;|,；，]|$)')
_TAG = re.compile(r"<(/?)([^\W\d][\w.\-:]*)((?:\s+[\w.\-:]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))*)\s*(/?)>")
_ATTRIBUTE = re.compile(r"([\w.\-:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_RULE = re.compile(r"[\s|:+-]*-[\s|:+-]*")
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"[^\S\n]")
_MIN_FIELDS = 2


def _hash(kind: bytes, parts: list[bytes]) -> bytes:
    h = hashlib.blake2b(kind, digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(4, "big"))
        h.update(p)
    return h.digest()


def _node(value: object) -> tuple[bytes, str, list[str]]:
    """Digest, canonical form and words (in their order) of a parsed value."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        parsed = _json(value)  # a structure within another notation
        value = value if parsed is None else parsed
    if isinstance(value, _Fields):
        kids = []
        said: list[str] = []
        for name, v in value:
            n, (d, form, ws) = words(name), _node(v)
            kids.append((_hash(b"field", [" ".join(n).encode(), d]), f"{' '.join(n)}={form}"))
            said += n + ws
        kids.sort()
        return _hash(b"object", [k[0] for k in kids]), "{" + ";".join(k[1] for k in kids) + "}", said
    if isinstance(value, list):
        nodes = [_node(v) for v in value]
        return _hash(b"array", [n[0] for n in nodes]), "[" + ";".join(n[1] for n in nodes) + "]", [w for n in nodes for w in n[2]]
    text = value if isinstance(value, str) else json.dumps(value)
    ws = words(text)
    return _hash(b"leaf", [w.encode() for w in ws]), " ".join(ws), ws


class _Fields(list):
    """Name-value pairs of one unordered node."""


def _json(text: str) -> object:
    """The JSON object or array that is all a text says, else None."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    end = max(text.rfind("}"), text.rfind("]")) + 1
    if at < 0 or end <= at or WORD.search(text[:at]) or WORD.search(text[end:]):
        return None
    try:
        return json.loads(_SPACE.sub(" ", text[at:end]), object_pairs_hook=_Fields, parse_float=str, parse_int=str, strict=False)
    except (ValueError, RecursionError):
        return None


def _masked(text: str) -> str:
    """The text with what stands in brackets, or in quotes right behind a mark, made unreadable at its place."""
    if '"' in text:
        text = _QUOTED.sub(lambda m: "\0" * len(m[0]), text)
    if "{" in text or "[" in text:
        out, depth, closed = list(text), 0, text.count("{") + text.count("[") == text.count("}") + text.count("]")
        for i, c in enumerate(text if closed else ""):
            depth += c in "{["
            out[i] = "\0" if depth > 0 else c
            depth -= c in "}]"
        text = "".join(out)
    return text


def _is_name(text: str) -> bool:
    return _LETTER.search(text) is not None


def _parted(text: str, masked: str, cut_at: re.Pattern) -> _Fields | None:
    """Fields between separators; parts without a word do not count."""
    out, at = _Fields(), 0
    for end in [*(m.start() for m in cut_at.finditer(masked)), len(text)]:
        part, at = text[at:end], end + 1
        m = _FIELD.match(part)
        if m and _is_name(m[1]):
            out.append((m[1], m[2]))
        elif WORD.search(part):
            return None
    return out if len(out) >= _MIN_FIELDS else None


def _run_on(text: str, masked: str, begin: re.Pattern) -> _Fields | None:
    """Fields of one-word names, each up to where the next name begins."""
    found = list(begin.finditer(masked))
    if len(found) < _MIN_FIELDS or WORD.search(text[: found[0].start()]):
        return None
    ends = [*(m.start() for m in found[1:]), len(text)]
    return _Fields((m[1], text[m.end() : e]) for m, e in zip(found, ends, strict=True)) if all(_is_name(m[1]) for m in found) else None


def _markup(text: str) -> _Fields | None:
    """Elements without mixed content, attributes included."""
    stack: list[tuple[str, _Fields, list[str]]] = [("", _Fields(), [])]
    at = 0
    for m in _TAG.finditer(text):
        stack[-1][2].append(text[at : m.start()])
        at = m.end()
        if m[1]:
            name, kids, said = stack.pop()
            if not stack or name != m[2] or kids and WORD.search("".join(said)):
                return None
            stack[-1][1].append((name, kids or "".join(said)))
        else:
            own = _Fields((a[1], a[2] if a[2] is not None else a[3]) for a in _ATTRIBUTE.finditer(m[3]))
            if m[4]:
                stack[-1][1].append((m[2], own or ""))
            else:
                stack.append((m[2], own, []))
    (name, kids, said) = stack[-1]
    whole = len(stack) == 1 and kids and not WORD.search("".join(said) + text[at:])
    return kids if whole and (len(kids) >= _MIN_FIELDS or isinstance(kids[0][1], _Fields)) else None


def _ruled(text: str) -> _Fields | None:
    """A table of a head and one row, or of rows of a name and a value."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not all("|" in x for x in lines):
        return None
    rows = [[c.strip() for c in x.strip("|").split("|")] for x in lines if not _RULE.fullmatch(x)]
    if len(rows) < 2 or len({len(r) for r in rows}) > 1 or len(rows[0]) < 2:
        return None
    headed = len(lines) > len(rows) and _RULE.fullmatch(lines[1]) is not None
    if headed and len(rows) == 2:
        return _Fields(zip(*rows, strict=True)) if all(map(_is_name, rows[0])) else None
    return _Fields(map(tuple, rows)) if len(rows[0]) == 2 and all(_is_name(r[0]) for r in rows) else None


def fields(text: str) -> list | None:
    """The statement's fields (or array of such) if it is made only of them, else None."""
    got = _json(text)
    if isinstance(got, list):
        if len(got) == 1 and not isinstance(got, _Fields):
            got = got[0]
        ordered = not isinstance(got, _Fields)
        return got if got and (not ordered or isinstance(got, list) and any(isinstance(v, _Fields) for v in got)) else None
    at, end = text.find("{"), text.rfind("}")
    if 0 <= at < end and not WORD.search(text[:at]) and not WORD.search(text[end:]):
        text = text[at + 1 : end]
    masked = _masked(text)
    marked = re.search(_MARK, masked) is not None
    parted = next((got for c in _CUTS if (got := _parted(text, masked, c))), None) if marked else None
    equals = _run_on(text, masked, _NEXT[0]) if "=" in masked else None
    if equals and (not parted or any(_INNER.search(_masked(v)) for _, v in parted)):
        return equals
    run_on = parted or (_run_on(text, masked, _NEXT[1]) if ":" in masked else None)
    if run_on:
        return run_on
    return (_markup(text) if "<" in text else None) or (_ruled(text) if "|" in text else None)


def merkle(text: str | None) -> tuple[bytes, str, bytes | None, str | None] | None:
    """(word digest, words, field digest, field form); the last two only for statements made of fields."""
    if not text or not WORD.search(text):
        return None
    found = fields(text)
    try:
        root, form, ws = (None, None, None) if found is None else _node(found)
    except RecursionError:  # nested beyond all reason: plain words
        root = None
    if root is None:
        digest, form, _ = _node(" ".join(words(text)))
        return digest, form, None, None
    # Markup says names twice; elsewhere the parsed words are those of the text, without its escapes.
    digest, said, _ = _node(" ".join(words(text) if text.lstrip().startswith("<") else ws))
    return digest, said, root, form


_OUT = "record_table string, id string, n_rows bigint, leaf binary, said string, root binary, form string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [merkle(s) for s in b.column("statement").to_pylist()]
        keep = pa.array([i for i, g in enumerate(got) if g], pa.int32())
        cols = list(zip(*[g for g in got if g], strict=True)) or [(), (), (), ()]
        out = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.binary(), pa.string()), strict=True)]
        own = [b.column(c).take(keep) for c in ("record_table", "id", "n_rows")]
        yield pa.RecordBatch.from_arrays([*own, *out], ["record_table", "id", "n_rows", "leaf", "said", "root", "form"])


def _joined_roots(clashes: DataFrame) -> DataFrame:
    """(record_table, root, least): least root of all that the same words connect. Only clashing roots come here."""
    pairs = clashes.select("record_table", F.col("lo").alias("a"), F.col("hi").alias("b"))
    pairs = cut(pairs.unionByName(pairs.select("record_table", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = pairs.groupBy("record_table", "a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    while True:
        near = pairs.join(label.withColumnRenamed("a", "b"), ["record_table", "b"]).groupBy("record_table", "a").agg(F.min("least").alias("near"))
        step = cut(label.join(near, ["record_table", "a"]).select("record_table", "a", F.least("least", "near").alias("least"), (F.col("near") < F.col("least")).alias("moved")))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            return label.withColumnRenamed("a", "root")


def twins(records: DataFrame) -> DataFrame:
    """(record_table, keep_id, copy_id, n_rows) from (record_table, id, statement): every member of every
    group, the kept one included; groups of one included."""
    # Rewrites of a record repeat its statement; they collapse in the map-side combine.
    one = records.where("statement is not null and id is not null").groupBy("record_table", "id", "statement").agg(F.count("*").alias("n_rows"))
    rows = cut(one.mapInArrow(_digests, _OUT))

    # Level one: statements with the same words. Keys hold the words themselves, not only their digest. A form
    # belongs to its root, so the greatest of both is that of a statement read as fields, if there is one.
    leaves = rows.groupBy("record_table", "leaf", "said").agg(F.min("id").alias("_id"), F.max("root").alias("hi"), F.max("form").alias("form"))
    # Words that are read as fields in two ways are rare. Whether there are any is told by numbers alone.
    number = F.xxhash64("root")
    clashing = rows.where("root is not null").groupBy("record_table", F.xxhash64("leaf", "said").alias("w")).agg(F.min(number).alias("lo"), F.max(number).alias("hi")).where("lo <> hi")
    if clashing.isEmpty():
        root, form = F.coalesce("hi", "leaf"), F.coalesce("form", "said")
        leaves = leaves.select("record_table", "leaf", "said", "_id", root.alias("root"), form.alias("form"))
    else:
        read = rows.where("root is not null").withColumn("w", F.xxhash64("leaf", "said")).join(clashing.select("record_table", "w"), ["record_table", "w"], "left_semi")
        extra = read.select("record_table", "leaf", "said", "root").distinct()
        least_root = extra.groupBy("record_table", "leaf", "said").agg(F.min("root").alias("lo"))
        wide = extra.join(least_root, ["record_table", "leaf", "said"]).select("record_table", "lo", F.col("root").alias("hi")).where("lo <> hi")
        least = _joined_roots(wide)
        leaves = leaves.join(least.withColumnRenamed("root", "hi"), ["record_table", "hi"], "left").select(
            "record_table", "leaf", "said", "_id",
            F.coalesce("least", "hi", "leaf").alias("root"),
            F.when(F.col("least").isNotNull(), F.lit("")).otherwise(F.coalesce("form", "said")).alias("form"),
        )
    # Level two: groups of the same root digest and canonical form.
    groups = leaves.groupBy("record_table", "root", "form").agg(F.min("_id").alias("keep_id"))
    keyed = leaves.join(groups, ["record_table", "root", "form"]).select("record_table", "leaf", "said", "keep_id")
    # The rows may crowd on one text; they are the streamed side, whose oversized partitions are split.
    return rows.join(keyed, ["record_table", "leaf", "said"]).select("record_table", "keep_id", F.col("id").alias("copy_id"), "n_rows")
