from __future__ import annotations

import random

import pytest

from chronomill.operators.intervals import merge_runs, periods_and_gaps

SCHEMA = "uri string, f double, t double, k string, s string"
INF = float("inf")


def run(df, **kw):
    return sorted(tuple(r) for r in periods_and_gaps(df, "uri", "f", "t", scale=4, **kw).collect())


def brute(rows):
    by = {}
    for uri, f, t, *_ in rows:
        t = INF if t is None else t
        if uri and f is not None and f > -INF and t > f:
            by.setdefault(uri, []).append((f, t))
    out = []
    whole = lambda x: -1 if x == INF else int(x * 4)
    for uri, spans in by.items():
        merged = []
        for f, t in sorted(spans):
            if merged and f <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([f, t])
        out += [(uri, "period", whole(f), whole(t)) for f, t in merged]
        out += [(uri, "gap", whole(a[1]), whole(b[0])) for a, b in zip(merged, merged[1:], strict=False)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    end = lambda f: rng.choice([None, INF]) if rng.random() < 0.03 else float((f or 0) + rng.choice([-3, 0, 0.25, 1, 6.5]))
    rows = []
    for _ in range(400):
        f = rng.choice([None, -INF]) if rng.random() < 0.05 else rng.randint(0, 800) / 4
        rows.append((rng.choice(["hot", "hot", "a", "b", "", None]), f, end(f if f and f > -INF else 0), "x", "y"))
    rows += rows[:50]
    for parts, runs in ((1, 1), (7, 15)):
        assert run(spark.createDataFrame(rows, SCHEMA).repartition(parts), runs=runs) == brute(rows)


def test_one_key_over_many_runs(spark):
    """Disjoint intervals, with long ones that reach over several runs and one without an end."""
    rows = [("hot", float(2 * k), float(2 * k + 1), "", "") for k in range(-20, 2000)] + [("hot", 100.0, 1500.5, "", ""), ("hot", 2000.0, 2002.0, "", ""), ("a", 1.0, 2.0, "", ""), ("z", 1.0, 2.0, "", "")]
    for more in ([], [("hot", 3001.5, None, "", "")]):
        assert run(spark.createDataFrame(rows + more, SCHEMA).repartition(4), runs=12) == brute(rows + more)


def test_touching_nested_and_empty(spark):
    rows = [("a", 0.0, 1.0, "", ""), ("a", 1.0, 2.0, "", ""), ("a", 0.25, 0.5, "", ""), ("a", 3.0, float("nan"), "", "")]
    assert run(spark.createDataFrame(rows, SCHEMA)) == [("a", "gap", 8, 12), ("a", "period", 0, 8), ("a", "period", 12, -1)]
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_merging_partial_lists_is_associative():
    import numpy as np

    rng = np.random.default_rng(1)
    c, s = rng.integers(0, 3, 200), rng.integers(0, 300, 200)
    e = s + rng.integers(1, 9, 200)
    whole = merge_runs(c, s, e)
    halves = [merge_runs(c[i::2], s[i::2], e[i::2]) for i in (0, 1)]
    assert all((a == b).all() for a, b in zip(whole, merge_runs(*map(np.concatenate, zip(*halves, strict=True))), strict=True))
