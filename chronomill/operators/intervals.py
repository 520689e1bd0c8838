"""Overlapping and gapped time intervals: continuous periods per key and the gaps between them.

The aggregate is a list of sorted, disjoint intervals per key, mergeable by a linear merge. It is reduced in a tree:
every scan task folds its rows into partial lists and hands them on whenever it holds ``HOLD_ROWS`` intervals; partial
lists meet in sorted runs, where they are merged in one stream; and what a key's list begins and ends with in
each run is merged last. Runs are cut by rows, so neither a key with a third of all rows nor one with any number of
disjoint intervals is ever brought together, and no task holds more than a batch and its own partial lists.

Defined cases: rows with a null or empty key, a null or infinite start, or an empty or reversed interval are
left out; a null, NaN or infinite end is open; intervals that overlap or touch are one; repeated rows change
nothing; a key with one period has no gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomill.common import cut
from chronomill.operators.runs import in_runs

OPEN = 2**62
HOLD_ROWS = 500_000


def merge_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of half-open intervals per code, sorted by code and start."""
    if not len(codes):
        return codes, starts, ends
    order = np.lexsort((starts, codes))
    codes, starts, ends = codes[order], starts[order], ends[order]
    levels, rank = np.unique(ends, return_inverse=True)
    # The highest end so far within a code: codes ascend, so they can lead the compared number.
    high = np.maximum.accumulate(codes * (len(levels) + 1) + rank) - codes * (len(levels) + 1)
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (starts[1:] > levels[high[:-1].clip(0)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(codes)) - 1
    return codes[at], starts[at], levels[high[last]]


def _codes(keys: pa.Array, known: dict[str, int]) -> np.ndarray:
    seen = keys.dictionary_encode()
    codes = np.array([known.setdefault(k, len(known)) for k in seen.dictionary.to_pylist()], np.int64)
    return codes[seen.indices.to_numpy()]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial lists of a scan task, one row for each interval."""
    known: dict[str, int] = {}
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def merged() -> tuple[np.ndarray, ...]:
        return merge_runs(*map(np.concatenate, zip(*parts, strict=True)))

    def out(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        names = pa.array(list(known), pa.string()).take(pa.array(codes))
        return pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array(ends)], ["k", "s", "e"])

    for b in batches:
        if not b.num_rows:
            continue
        parts.append((_codes(b.column(0), known), b.column(1).to_numpy(), b.column(2).to_numpy()))
        held += b.num_rows
        if held > HOLD_ROWS:
            parts = [merged()]
            held = len(parts[0][0])
            if held > HOLD_ROWS // 2:  # merging no longer shrinks them
                yield out(*parts[0])
                known, parts, held = {}, [], 0
    if parts:
        yield out(*merged())


def _merge(run: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Disjoint intervals of a sorted run, each with the next start of its key; those of the run's first and last key marked."""
    held: pa.RecordBatch | None = None  # the last interval so far, which may go on
    first: str | None = None

    def rows(keys: pa.Array, s: np.ndarray, e: np.ndarray, following: pa.Array, is_last: bool) -> pa.RecordBatch:
        n = len(s)
        edge = np.array([is_last or k == first for k in keys.to_pylist()], bool)
        cols = [pa.array(np.full(n, run, np.int64)), keys, pa.array(s), pa.array(e), following, pa.array(edge)]
        return pa.RecordBatch.from_arrays(cols, ["run", "k", "s", "e", "following", "edge"])

    for b in batches:
        if not b.num_rows:
            continue
        first = b.column(0)[0].as_py() if first is None else first
        t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        known: dict[str, int] = {}
        code, s, e = merge_runs(_codes(t.column(0), known), t.column(1).to_numpy(), t.column(2).to_numpy())
        keys = pa.array(list(known), pa.string()).take(pa.array(code))
        n = len(s) - 1
        if n:
            yield rows(keys.slice(0, n), s[:n], e[:n], pa.array(s[1:], mask=code[1:] != code[:-1]), False)
        held = pa.RecordBatch.from_arrays([keys.slice(n), pa.array(s[n:]), pa.array(e[n:])], ["k", "s", "e"])
    if held is not None:
        yield rows(held.column(0), held.column(1).to_numpy(), held.column(2).to_numpy(), pa.nulls(1, pa.int64()), True)


def _stitched(lists: DataFrame) -> DataFrame:
    """The lists of all runs with what goes on across their borders merged: (k, s, e, following)."""
    edge = lists.where("edge")
    # What each key of a border has in each of its runs, and how far earlier runs reach into it.
    own = Window.partitionBy("k").orderBy("run")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    reach = edge.groupBy("k", "run").agg(F.max("e").alias("_top")).select("k", "run", F.max("_top").over(earlier).alias("_reach"))
    held = edge.join(reach.where("_reach is not null"), ["k", "run"], "left").withColumn("_fresh", F.col("_reach").isNull() | (F.col("s") > F.col("_reach")))
    held = cut(held)
    # Up to the run that has the key's next period, what does not begin one only makes the last one longer.
    parts = held.groupBy("k", "run").agg(F.max(F.when(~F.col("_fresh"), F.col("e"))).alias("_longer"), F.min(F.when(F.col("_fresh"), F.col("s"))).alias("_begin"))
    begun = F.count("_begin").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.select("*", begun.alias("_upto"), (begun - F.col("_begin").isNotNull().cast("int")).alias("_since"))
    onward = parts.groupBy("k", F.col("_since").alias("_upto")).agg(F.max("_longer").alias("_longer"), F.min("_begin").alias("_next"))
    last = parts.where("_begin is not null").select("k", "run", "_upto").join(onward, ["k", "_upto"], "left")
    ends = held.where("_fresh").join(last.drop("_upto"), ["k", "run"], "left")
    is_last = F.col("following").isNull()
    return lists.where("not edge").select("k", "s", "e", "following").unionByName(
        ends.select(
            "k", "s",
            F.when(is_last, F.greatest("e", "_longer")).otherwise(F.col("e")).alias("e"),
            F.when(is_last, F.col("_next")).otherwise(F.col("following")).alias("following"),
        )
    )


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, scale: int = 1, runs: int | None = None) -> DataFrame:
    """(key, kind, from_at, to_at): per key its 'period' rows and the 'gap' rows between them.

    Times are multiplied by ``scale`` and rounded to whole numbers; -1 is the open end.
    """
    inf = F.lit(float("inf"))
    begin, until = F.col(start).cast("double"), F.col(end).cast("double")
    begin = F.when(~F.isnan(begin) & (F.abs(begin) < inf), begin)
    until = F.when(until.isNull() | F.isnan(until), inf).otherwise(until)
    rows = df.where((F.col(key) != "") & (until > begin)).select(
        F.col(key).alias("k"),
        F.round(begin * scale).cast("bigint").alias("s"),
        F.when(until == inf, F.lit(OPEN)).otherwise(F.round(until * scale).cast("bigint")).alias("e"),
    )
    partial = rows.mapInArrow(_fold, "k string, s bigint, e bigint")
    lists = cut(in_runs(partial, ["k", "s", "e"], _merge, "run bigint, k string, s bigint, e bigint, following bigint, edge boolean", runs))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_at"), F.when(b >= OPEN, -1).otherwise(b).alias("to_at"))
    s, e, following = F.col("s"), F.col("e"), F.col("following")
    both = F.array(row("period", s, e), F.when(following.isNotNull(), row("gap", e, following)))
    return _stitched(lists).select(F.col("k").alias(key), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("_r")).select(key, "_r.*")
