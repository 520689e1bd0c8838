"""Joins with a decision: optimal assignment, field differences, overlays, tree and evidence comparison."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomill.operators import assignment

DENSE = 1 << 20
"""Pairs up to which the assignment by shared words is solved over a matrix."""


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a least-cost assignment of rows to columns (shortest augmenting paths with potentials)."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, reach = i, -1, 0.0
        while True:
            slack = reach + c[row] - u[row] - v
            better = ~done & (slack < dist)
            dist[better], prev[better] = slack[better], col
            ahead = np.where(done, np.inf, dist)
            reach = ahead.min()
            ties = np.flatnonzero(ahead == reach)
            free = ties[owner[ties] < 0]  # of equally near columns a free one ends the search
            col = int(free[0] if len(free) else ties[0])
            done[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
        settled = done.copy()
        settled[col] = False
        u[i] += reach
        u[owner[settled]] += reach - dist[settled]
        v[settled] -= reach - dist[settled]
        while col >= 0:
            before = int(prev[col])
            owner[col] = owner[before] if before >= 0 else i
            col = before
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


def best_pairs(scored: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """(group, left, right, score): per group the one-to-one pairs with the greatest total score.

    ``scored`` has the candidate pairs with a positive score; a pair that is not there cannot be chosen.
    Candidates come from an equi join, so no group is ever crossed with itself.
    """
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema.fields}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([left, right])
        rows, a = np.unique(pdf[left].to_numpy(), return_inverse=True)
        cols, b = np.unique(pdf[right].to_numpy(), return_inverse=True)
        table = np.zeros((len(rows), len(cols)))
        table[a, b] = pdf[score]
        kept = [(i, j) for i, j in assign(-table) if table[i, j] > 0]
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(kept), left: [rows[i] for i, _ in kept], right: [cols[j] for _, j in kept], score: [table[i, j] for i, j in kept]})

    schema = f"{group} {kinds[group]}, {left} {kinds[left]}, {right} {kinds[right]}, {score} double"
    return scored.select(group, left, right, F.col(score).cast("double").alias(score)).groupBy(group).applyInPandas(solve, schema)


def word_pairs(side: pa.Array, key: pa.Array, words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Keys of side 0, of side 1 and numbers of shared words of the best pairs of one group."""
    n = pc.sum(side).as_py()
    if n * (len(side) - n) > DENSE:
        order = pc.sort_indices(key)
        rows = [order.filter(pc.equal(side.take(order), k)) for k in (0, 1)]
        lists = [words.take(r) for r in rows]
        numbered = pa.chunked_array([x.flatten() for x in lists]).dictionary_encode()  # one numbering for both sides
        i, j, w = assignment.assign_words(*((np.r_[0, np.cumsum(x.value_lengths())], c.indices.to_numpy()) for x, c in zip(lists, numbered.chunks, strict=True)))
        return key.take(rows[0].take(pa.array(i))), key.take(rows[1].take(pa.array(j))), pa.array(w.astype(float))
    ids: tuple[list, list] = ([], [])
    at: dict[str, tuple[list[int], list[int]]] = {}
    for i, k, ws in sorted(zip(key.to_pylist(), side.to_pylist(), words.to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0])):
        for w in ws:
            at.setdefault(w, ([], []))[k].append(len(ids[k]))
        ids[k].append(i)
    cost = np.zeros([len(x) for x in ids], np.int32)
    for a, b in at.values():
        if a and b:
            cost[np.array(a)[:, None], b] -= 1
    kept = [(i, j) for i, j in assign(cost) if cost[i, j] < 0] if cost.size else []
    return pa.array([ids[0][i] for i, _ in kept], key.type), pa.array([ids[1][j] for _, j in kept], key.type), pa.array([-float(cost[i, j]) for i, j in kept], pa.float64())


def best_word_pairs(lefts: DataFrame, rights: DataFrame, group: str, left: str, right: str, words: str, score: str) -> DataFrame:
    """(group, left, right, score): as ``best_pairs``, scored by the number of shared ``words`` (distinct ones).

    Each record is shuffled once, not each pair.
    """
    side = lambda d, k, c: d.select(group, F.lit(k).alias("_side"), F.col(c).alias("_id"), words)
    return best_side_pairs(side(lefts, 0, left).unionByName(side(rights, 1, right)), group, "_side", "_id", words, left, right, score)


def best_side_pairs(records: DataFrame, group: str, side: str, key: str, words: str, left: str, right: str, score: str) -> DataFrame:
    """As ``best_word_pairs``, of one table whose ``side`` is 0 or 1.

    A group is solved whole in one task: a small one over a matrix, a larger one by ``assignment``, whose memory grows
    with the records.
    """
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}

    def solve(t: pa.Table) -> pa.Table:
        a, b, w = word_pairs(*(t[c].combine_chunks() for c in ("_side", "_id", "_words")))
        return pa.table([pa.array([t[group][0].as_py()] * len(w), t[group].type), a, b, w], names=[group, left, right, score])

    schema = f"{group} {kinds[group]}, {left} {kinds[key]}, {right} {kinds[key]}, {score} double"
    rows = records.where((F.size(words) > 0) & F.col(side).isin(0, 1)).select(group, F.col(side).cast("int").alias("_side"), F.col(key).alias("_id"), F.col(words).alias("_words"))
    return rows.groupBy(group).applyInArrow(solve, schema)


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, left_value, right_value) where two tables differ in a field; null equals null."""
    l, r = (d.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(s)) for d, s in ((a, "_l"), (b, "_r")))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_l.{f}").alias("left_value"), F.col(f"_r.{f}").alias("right_value")) for f in fields])
    return l.join(r, key).select(key, F.explode(rows).alias("_d")).select(key, "_d.*").where("not (left_value <=> right_value)")


def tree_difference(before: DataFrame, after: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """(keys, difference): MISSING in the second tree, EXTRA in it, or with another digest."""
    j = before.select(*keys, F.col(digest).alias("_a"), F.lit(1).alias("_ia")).join(after.select(*keys, F.col(digest).alias("_b"), F.lit(1).alias("_ib")), list(keys), "full")
    kind = F.when(F.col("_ib").isNull(), "MISSING").when(F.col("_ia").isNull(), "EXTRA").when(~F.col("_a").eqNullSafe(F.col("_b")), "SHA_MISMATCH")
    return j.withColumn("difference", kind).where("difference is not null").select(*keys, "difference")


def evidence_status(wanted: DataFrame, evidence: DataFrame, key: str, fingerprint: Column, status: str = "status") -> DataFrame:
    """Adds ``evidence_status``: NOT_EXECUTED without evidence, STALE_AUDIT under another fingerprint, else its status."""
    e = evidence.select(key, F.col("fingerprint").alias("_fp"), F.col(status).alias("_st"))
    j = wanted.withColumn("_now", fingerprint).join(e, key, "left")
    verdict = F.when(F.col("_fp").isNull(), "NOT_EXECUTED").when(F.col("_fp") != F.col("_now"), "STALE_AUDIT").otherwise(F.col("_st"))
    return j.withColumn("evidence_status", verdict).drop("_fp", "_st", "_now")


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two tables with the same columns; a value of the second that is set wins."""
    cols = [c for c in base.columns if c != key]
    l, r = base.select(key, *[F.col(c).alias(f"_l_{c}") for c in cols]), top.select(key, *[F.col(c).alias(f"_r_{c}") for c in cols])
    return l.join(r, key, "full").select(key, *[F.coalesce(f"_r_{c}", f"_l_{c}").alias(c) for c in cols])


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, combined before the shuffle by the window's group limit."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
