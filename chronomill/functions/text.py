"""Text functions as column expressions: tokens, names, paths, excerpts, fences, scans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronomill.common import col

# Character classes spelled out, so that they mean the same in every engine.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
MARK = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def tokens(c: str | Column, least: int = 1) -> Column:
    """Runs of letters, digits and underscores in lower case, at least ``least`` characters long."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(WORD + "+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def ascii_tokens(c: str | Column) -> Column:
    """Whole runs of letters, digits and underscores that are ASCII only, in lower case."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(WORD + "+"), F.lit(0))
    return F.filter(found, lambda t: t.rlike("^[a-z0-9_]+$"))


def long_tokens(c: str | Column, least: int = 4) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))


def simple_tokens(c: str | Column) -> Column:
    """Words and single marks: the unit of a simple budget."""
    return F.regexp_extract_all(col(c), F.lit(f"{WORD}+|{MARK}"), F.lit(0))


def split_words(c: str | Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(col(c), SPACE + "+"), lambda w: w != "")


def normal_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def same_lines(a: Column, b: Column) -> Column:
    """Equal but for carriage returns."""
    return F.replace(a, F.lit("\r\n"), F.lit("\n")).eqNullSafe(F.replace(b, F.lit("\r\n"), F.lit("\n")))


def normal_symbol(c: str | Column) -> Column:
    """A symbol name without blanks around it, call brackets behind it, or one quote at either end."""
    bare = F.rtrim(F.trim(F.coalesce(col(c), F.lit(""))), F.lit("()"))
    quoted = lambda x: x.isin("'", '"')
    opened = F.when(quoted(F.left(bare, F.lit(1))), F.substr(bare, F.lit(2))).otherwise(bare)
    return F.when(quoted(F.right(opened, F.lit(1))), F.left(opened, F.length(opened) - 1)).otherwise(opened)


def short_symbol(c: str | Column) -> Column:
    return F.element_at(F.split(normal_symbol(c), r"\."), -1)


def symbols_match(a: Column, b: Column, statement: Column) -> Column:
    """Equal in full or in their last part, or both last parts mentioned by the statement."""
    na, nb = F.lower(normal_symbol(a)), F.lower(normal_symbol(b))
    sa, sb, said = F.lower(short_symbol(a)), F.lower(short_symbol(b)), F.lower(F.coalesce(statement, F.lit("")))
    named = (sa != "") & (sb != "") & F.contains(said, sa) & F.contains(said, sb)
    return (na != "") & (nb != "") & ((na == nb) | (sa == sb) | named)


def basename(c: str | Column) -> Column:
    return F.substring_index(col(c), "/", -1)


def paths_match(a: Column, b: Column) -> Column:
    """Same file name, or one path ends with the other."""
    return (basename(a) == basename(b)) | F.endswith(a, b) | F.endswith(b, a)


def fenced(c: str | Column, language: str = "python") -> Column:
    """Contents of fenced blocks of a language, in order."""
    return F.regexp_extract_all(col(c), F.lit(f"(?s)```{language}\\s*(.*?)\\s*```"), F.lit(1))


def longest(items: Column) -> Column:
    """The longest element, the first of equals."""
    sized = F.transform(items, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(sized)["x"]


def fenced_json(c: str | Column) -> Column:
    """The first fenced JSON block, or the text itself."""
    inner = F.regexp_extract(col(c), r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(col(c))


def packed_files(c: str | Column) -> Column:
    """File names in the headers of a packed context."""
    return F.regexp_extract_all(col(c), F.lit(r"(?m)^# File: (.*?) \(Lines"), F.lit(1))


def terms_beyond(statement: Column, base: Column, terms: Sequence[str]) -> Column:
    """The terms that the statement has and the base text has not."""
    said, known = F.lower(statement), F.lower(F.coalesce(base, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(said, t) & ~F.contains(known, t))


# Wordings of a lower and of an upper bound of versions.
AT_LEAST, BELOW = ("or later", "or higher", "+"), "but less than"


def impossible_range(c: str | Column) -> Column:
    """Whether versions of two or three numbers are claimed from X on but below Y, where X is not below Y."""
    version = r"(\d+(?:\.\d+){1,2})"
    said = rf"{version}\s*(?:{'|'.join(map(re.escape, AT_LEAST))})\s*{BELOW.replace(' ', chr(92) + 's*', 1)}\s*{version}"
    text = F.lower(col(c))
    number = lambda g, i: F.coalesce(F.try_element_at(F.split(F.regexp_extract(text, said, g), r"\."), F.lit(i)), F.lit("0")).try_cast("int")
    bound = lambda g: F.struct(*[number(g, i).alias(f"n{i}") for i in (1, 2, 3)])
    return text.rlike(said) & (bound(1) >= bound(2))


def always_contradicted(statement: Column, source: Column) -> Column:
    """'Always returns true' where the source only returns false, and the other way round."""
    said, code = F.lower(statement), F.lower(F.coalesce(source, F.lit("")))
    one = lambda a, b: F.contains(said, F.lit(f"always returns {a}")) & F.contains(code, F.lit(f"return {b}")) & ~F.contains(code, F.lit(f"return {a}"))
    return one("true", "false") | one("false", "true")


def near_words(a: Column, b: Column, prefix: int = 4) -> Column:
    """How many words of ``a`` share their first letters with a word of ``b``."""
    return F.size(F.filter(a, lambda w: F.exists(b, lambda p: F.startswith(p, F.left(w, F.lit(prefix))))))


def excerpt(c: str | Column, term: Column, before: int = 2, after: int = 8) -> Column:
    """The lines around the first one that holds a term; null where none does."""
    lines = F.split(col(c), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, term)), True)
    first = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(lines, first, at + after - first + 1), "\n"))


def issue_number(c: str | Column) -> Column:
    """Number at the end of a pull request or issue address; null where there is none."""
    return F.regexp_extract(col(c), r"/(?:pull|issues)/(\d+)", 1).try_cast("bigint")


def fingerprint(*parts: Column) -> Column:
    """Digest over ordered parts; a missing part has a mark of its own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("MISSING")) for p in parts]), 256)
