"""Evaluation texts leaking into training text, verbatim or with other parameters.

Texts are sequences of words (maximal runs of letters or digits, case ignored). Each word is canonicalised into a
typed placeholder or stays: a *number* begins with a digit; the words that make up templates stay; any other word
is a *unit* right behind a number of the same window, else a *name*. A template of a window of twelve words has its
words and placeholders in order, each placeholder with the place of its value's first occurrence, so two windows have
the same template exactly where their fixed words are equal and their slot values correspond one to one. Windows
of the corpus are hash-joined with those of the items by template; a leak is verbatim where the slots hold the
item's own values, which a digest of the words confirms.

Template words are the items' words that at least one in ``ONE_IN`` documents or items uses (items: three at
least). A window with fewer than ``LEAST_FIXED`` of them says too little to be a template; it leaks verbatim only.

Scale: the corpus is read once for windows (and once for the counts of words, where templates are asked for) and
only windows that a Bloom filter of the items' windows lets through are shuffled. What is broadcast is that filter,
at most ``MOST_BITS`` bits whatever the number of items, and the template words, of which there are at most
``ONE_IN`` times as many as distinct words in a mean document or item. Items are never brought to the driver.

Defined cases: null, empty and short texts (fewer words than a window) neither leak nor are leaked; equal
documents each come out; repeated items are items of their own; long texts are searched whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomill.llm.words import words

WINDOW = 12
ONE_IN, TEMPLATE_ITEMS = 1000, 3
LEAST_FIXED = 3
BITS_A_KEY, MOST_BITS, LEAST_BITS = 16, 1 << 28, 1 << 16
_PROBES = 4
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_SLICE_WORDS, _KNOWN_MOST = 300_000, 200_000


def _h(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _digest(ws: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(ws).encode("utf-8", "surrogatepass"), digest_size=16).digest()


_NUMBER, _UNIT, _NAME = (_h(f"<{k}>") for k in ("number", "unit", "name"))


def windows(h: np.ndarray, n: int = WINDOW, first: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n numbers from each position on (modulo 2**64); ``first`` stands for a window's first number."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = (h if first is None else first)[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _MULTIPLIER + h[j : len(h) - n + 1 + j]
    return out ^ (out >> np.uint64(31))


def template_of(ws: list[str], fixed: frozenset, least_fixed: int = LEAST_FIXED) -> bytes:
    """Digest of a window's template; of its words where it has too few template words."""
    if sum(w in fixed for w in ws) < least_fixed:
        return _digest(ws)
    out, numeric = [], False
    for w in ws:
        kind = "#" if w[0].isnumeric() else "%" if numeric else "@"
        numeric = kind == "#"
        out.append(w if w in fixed else f"{kind}{ws.index(w)}")
    return _digest(out)


class Canonical:
    """Hash keys of the windows of many texts; the numbers of words are kept for reuse."""

    def __init__(self, fixed: frozenset, least_fixed: int = LEAST_FIXED) -> None:
        self.fixed, self.least_fixed = fixed, least_fixed
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.rows: tuple[list, list, list, list] = ([], [], [], [])

    def _numbers(self, ws: list[str]) -> tuple[np.ndarray, ...]:
        if len(self.code) > _KNOWN_MOST:
            self._clear()
        code = self.code
        for w in set(ws).difference(code):
            code[w] = len(code)
            stays, numeric, h = w in self.fixed, w[0].isnumeric(), _h(w)
            for col, v in zip(self.rows, (h, h if stays else _NUMBER if numeric else _NAME, stays, numeric), strict=True):
                col.append(v)
        at = np.fromiter(map(code.__getitem__, ws), np.int64, len(ws))
        return tuple(np.array(c, t)[at] for c, t in zip(self.rows, (np.uint64, np.uint64, bool, bool), strict=True))

    def slices(self, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(words, text of each word, places of windows, their keys), many texts at a time."""
        i = 0
        while i < len(texts):
            said: list[str] = []
            sizes, j = [], i
            while j < len(texts) and (j == i or len(said) < _SLICE_WORDS):
                ws = words(texts[j])
                said += ws
                sizes.append(len(ws))
                j += 1
            own = np.repeat(np.arange(i, j), sizes)
            i = j
            if len(said) < WINDOW:
                continue
            exact, alone, stays, numeric = self._numbers(said)
            follows = np.append(False, numeric[:-1]) & ~stays & ~numeric
            canonical = windows(np.where(follows, np.uint64(_UNIT), alone), first=alone)
            count = np.append(0, np.cumsum(stays))
            key = np.where(count[WINDOW:] - count[:-WINDOW] >= self.least_fixed, canonical, windows(exact))
            place = np.flatnonzero(own[: len(key)] == own[WINDOW - 1 :])
            yield said, own, place, key[place]


def _probes(keys: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    """Bits of each key in a filter of ``n_bits``, a power of two."""
    step = (keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for k in range(_PROBES):
        yield (keys + np.uint64(k) * step) & np.uint64(n_bits - 1)


def _passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the keys that a filter lets through."""
    left = np.arange(len(keys))
    for k in range(_PROBES):
        bit = next(b for j, b in enumerate(_probes(keys[left], len(bits) * 64)) if j == k)
        left = left[(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return left


def _partial_bits(keys: np.ndarray, n_bits: int) -> pa.RecordBatch:
    """Words of the filter that some keys set bits in."""
    bit = np.unique(np.concatenate(list(_probes(keys, n_bits)))) if len(keys) else np.empty(0, np.uint64)
    at, first = np.unique(bit >> np.uint64(6), return_index=True)
    word = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(bit) else bit
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(word.view(np.int64))], ["at", "bits"])


def _filter_bits(partial: DataFrame, n_bits: int) -> np.ndarray:
    """The filter, from the parts that tasks made: of a fixed size, whatever went into it."""
    out = np.zeros(n_bits >> 6, np.uint64)
    got = partial.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def bits_for(n_keys: int, most_bits: int = MOST_BITS) -> int:
    return min(most_bits, max(LEAST_BITS, 1 << (max(n_keys, 1) * BITS_A_KEY - 1).bit_length()))


def _word_keys(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_h, ws), np.uint64, len(ws))


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Words with the number of texts they are in, only those that a filter lets through."""
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        ws = list(n)
        if bits is not None and ws:
            ws = [ws[k] for k in _passes(_word_keys(ws), bits)]
        batch = pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([n[w] for w in ws], pa.int64())], ["w", "n"])
        n.clear()
        return batch

    for b in batches:
        for t in b.column(0).to_pylist():
            n.update(set(words(t)))
        if len(n) > _KNOWN_MOST:
            yield out()
    yield out()


def template_words(docs: DataFrame | None, text: str, items: DataFrame, item_text: str, one_in: int = ONE_IN, most_bits: int = MOST_BITS) -> frozenset:
    """The items' words that are common in the items or in the documents; without documents, in the items."""
    spark = items.sparkSession
    counted = lambda df, c, run: df.select(c).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    used = counted(items, item_text, _counted)
    common = used.where(F.col("n") >= max(TEMPLATE_ITEMS, -(-items.count() // one_in)))
    if docs is not None:
        n_bits = bits_for(used.count(), most_bits)

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _partial_bits(_word_keys(b.column(0).to_pylist()), n_bits)

        sent = spark.sparkContext.broadcast(_filter_bits(used.select("w").mapInArrow(parts, "at int, bits bigint"), n_bits))
        in_docs = counted(docs, text, lambda batches: _counted(batches, sent.value))
        frequent = in_docs.where(F.col("n") >= max(2, -(-docs.count() // one_in)))
        common = common.select("w").unionByName(frequent.join(used.select("w"), "w", "left_semi").select("w")).distinct()
    return frozenset(r[0] for r in common.select("w").collect())


def _scanned(canonical: Callable[[], Canonical], bits: Callable[[], np.ndarray | None]) -> Callable:
    """Windows of texts with the digests of their template and of their words, only those that a filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, let = canonical(), bits()
        for b in batches:
            at, templates, exact = [], [], []
            for said, owner, place, keys in own.slices(b.column(1).to_pylist()):
                place = place if let is None else place[_passes(keys, let)]
                at += owner[place].tolist()
                for p in place.tolist():
                    ws = said[p : p + WINDOW]
                    templates.append(template_of(ws, own.fixed, own.least_fixed))
                    exact.append(_digest(ws))
            cols = [b.column(0).take(pa.array(at, pa.int32())), pa.array(templates, pa.binary()), pa.array(exact, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "template", "exact"])

    return run


def windows_of(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, fixed: frozenset, least_fixed: int = LEAST_FIXED, most_bits: int = MOST_BITS
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, template, exact) of the documents' windows that items may have, and (item_id, template, exact) of all of the items'."""
    spark = docs.sparkSession
    schema = lambda df, c: f"id {df.schema[c].dataType.simpleString()}, template binary, exact binary"
    told = spark.sparkContext.broadcast((fixed, least_fixed))
    canonical = lambda: Canonical(*told.value)
    theirs = items.select(item_id, item_text).mapInArrow(_scanned(canonical, lambda: None), schema(items, item_id)).withColumnRenamed("id", "item_id")
    n_bits = bits_for(theirs.count(), most_bits)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = canonical()
        for b in batches:
            yield _partial_bits(np.concatenate([np.empty(0, np.uint64), *(k for *_, k in own.slices(b.column(0).to_pylist()))]), n_bits)

    sent = spark.sparkContext.broadcast(_filter_bits(items.select(item_text).mapInArrow(parts, "at int, bits bigint"), n_bits))
    ours = docs.where(F.length(text) > 0).select(doc_id, text).mapInArrow(_scanned(canonical, lambda: sent.value), schema(docs, doc_id))
    return ours.withColumnRenamed("id", "doc_id"), theirs


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bits: int = MOST_BITS
) -> DataFrame:
    """(doc_id, item_id) of each document and item that share a window of words.

    Windows meet by template, and their slots must hold the same values. What counts as a template word then changes
    nothing but the templates themselves, so the items' own counts decide it.
    """
    fixed = template_words(None, text, items, item_text)
    ours, theirs = windows_of(docs, items, doc_id, text, item_id, item_text, fixed, most_bits=most_bits)
    return ours.distinct().join(theirs.distinct(), ["template", "exact"]).select("doc_id", "item_id").distinct()


def templates(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    one_in: int = ONE_IN, least_fixed: int = LEAST_FIXED, most_bits: int = MOST_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Documents with the templates they hold, and the items that have these.

    Many items may share one template, so a document is not paired with each of them: (doc_id, template_id, n_windows,
    n_verbatim) has one row for each document and template, named by the least item that has the window, with how many
    windows of the document have it and how many of these with an item's own words; (template_id, item_id) tells
    which items share windows with it.
    """
    fixed = template_words(docs, text, items, item_text, one_in, most_bits)
    ours, theirs = windows_of(docs, items, doc_id, text, item_id, item_text, fixed, least_fixed, most_bits)
    named = theirs.groupBy("template").agg(F.min("item_id").alias("template_id"))
    spoken = theirs.select("template", "exact").distinct().withColumn("same", F.lit(True))
    counted = ours.groupBy("doc_id", "template", "exact").agg(F.count("*").alias("n"))
    met = counted.join(named, "template").join(spoken, ["template", "exact"], "left")
    held = met.groupBy("doc_id", "template_id").agg(F.sum("n").alias("n_windows"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("n_verbatim"))
    return held, theirs.join(named, "template").select("template_id", "item_id").distinct()


def by_item(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item the number of documents that leak it, and its rank; items that nothing leaks included."""
    n = found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "split").join(n, "item_id", "left").select(
        "item_id", "split", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"),
        F.rank().over(Window.partitionBy("split").orderBy(F.desc(F.coalesce("n_docs", F.lit(0))))).alias("rank"),
    )
