from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronomill.operators.history import ledger, versions

SCHEMA = "ingest_seq bigint, id string, created_at bigint, a bigint, b string, _id string, _state string"
ATTRIBUTES = lambda: {"a": F.col("a"), "b": F.col("b")}


def brute(rows):
    out = []
    for i in sorted({r[1] for r in rows if r[1] is not None}):
        last = {}
        for r in sorted((r for r in rows if r[1] == i and r[2] is not None), key=lambda r: (r[2], r[0] if r[0] is not None else -1)):
            last[r[2]] = (r[3], r[4])
        kept = []
        for t in sorted(last):
            if not kept or kept[-1][1] != last[t]:
                kept.append((t, last[t]))
        out += [(i, t, kept[k + 1][0] if k + 1 < len(kept) else 999999999, *s) for k, (t, s) in enumerate(kept)]
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted(map(tuple, versions(df, "id", "created_at", "ingest_seq", ATTRIBUTES(), **kw).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("runs", [12])
def test_against_brute_force(spark, seed, runs):
    rng = random.Random(seed)
    ids = ["hot"] * 6 + [f"i{k}" for k in range(8)] + [None]
    rows = [(n, rng.choice(ids), rng.choice([rng.randint(0, 90), None]) if rng.random() < 0.1 else rng.randint(0, 90), rng.choice([1, 2, None]), rng.choice(["x", None]), "c", "c") for n in range(160)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df, runs=runs, run_rows=25) == brute(rows)


def replayed(rows):
    """The ledger by taking in one write after the other."""
    out = []
    for i in sorted({r[1] for r in rows if r[1] is not None}):
        open_ = {}  # version_from -> [version_to, recorded_from, state]
        for r in sorted((r for r in rows if r[1] == i and r[2] is not None), key=lambda r: r[0]):
            t, seq, state = r[2], r[0], (r[3], r[4])
            over = max((a for a in open_ if a <= t), default=None)
            until = min((a for a in open_ if a > t), default=999999999)
            if over is not None:
                end, since, old = open_.pop(over)
                if since < seq:
                    out.append((i, over, end, since, seq, *old))
                if over < t:
                    open_[over] = [t, seq, old]
            open_[t] = [until, seq, state]
        out += [(i, a, end, since, None, *state) for a, (end, since, state) in open_.items()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("runs", [9])
def test_ledger_against_replay(spark, seed, runs):
    rng = random.Random(seed)
    ids = ["hot"] * 20 + [f"i{k}" for k in range(5)] + [None]
    ticks = lambda n: rng.choice([n, n, rng.randint(0, 200)])  # noqa: E731 mostly in order, some late, some ahead
    rows = [(n, rng.choice(ids), ticks(n) if rng.random() < 0.95 else None, rng.choice([1, 2]), rng.choice(["x", None]), "c", "c") for n in range(200)]
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    got = ledger(spark.createDataFrame(rows, SCHEMA), "id", "created_at", "ingest_seq", ATTRIBUTES(), runs=runs, run_rows=25).collect()
    assert sorted(map(tuple, got), key=repr) == replayed(rows)


@pytest.mark.parametrize("order", ["up", "mixed"])
def test_ledger_of_one_entity_over_many_runs(spark, order):
    n = 1000
    ticks = {"up": range(n), "down": range(n, 0, -1), "mixed": random.Random(1).sample(range(n), n)}[order]
    rows = [(k, "e", t, t % 3, "x", "", "") for k, t in enumerate(ticks)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ledger(df, "id", "created_at", "ingest_seq", ATTRIBUTES(), runs=10, run_rows=25).collect()
    assert sorted(map(tuple, got), key=repr) == replayed(rows)
    assert run(df, runs=10, run_rows=25) == brute(rows)


def test_same_tick_and_unchanged(spark):
    rows = [(1, "r", 5, 1, "x", "", ""), (2, "r", 5, 2, "x", "", ""), (3, "r", 9, 2, "x", "", ""), (4, "r", 3, 2, "x", "", "")]
    assert run(spark.createDataFrame(rows, SCHEMA)) == [("r", 3, 999999999, 2, "x")]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty) == [] and ledger(empty, "id", "created_at", "ingest_seq", ATTRIBUTES()).count() == 0
