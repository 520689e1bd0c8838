from __future__ import annotations

import random

from pyspark.sql import functions as F

from chronomill.operators import references as R

REFS = "ingest_seq bigint, keys array<string>, one string, at double, kind string"
PARENTS = "key string, at double, gone double, ref_key string"


def refs_of(df):
    return R.array_refs(df, "many", "p", "keys", "ingest_seq", "at").unionByName(R.scalar_refs(df, "one", "p", "one", "ingest_seq", "at"))


def found(state):
    return sorted(map(tuple, state.orphans().select("ref_field", "ingest_seq", "ref_key").collect()))


def random_case(seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(12)]
    noisy = lambda k: rng.choice([k, k.upper(), f" {k}\t", f"\xa0{k} "])
    rows = []
    for i in range(60):
        many = [rng.choice([None, "", " ", noisy(rng.choice(keys))]) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([many, None]), rng.choice([None, "", noisy(rng.choice(keys))]), rng.choice([float(rng.randint(0, 40)), None]), "x"))
    parents = [(rng.choice(keys), float(rng.randint(0, 40)), rng.choice([None, float(rng.randint(0, 60))]), "x") for _ in range(14)]
    return rows, parents


def brute(rows, parents):
    out = []
    for seq, many, one, at, _ in rows:
        if at is None:
            continue
        listed = [("many", k) for k in {(x or "").strip().lower() for x in many or []}] + [("one", (one or "").strip().lower())]
        for field, k in listed:
            if not k:
                continue
            first = [p[1] for p in parents if p[0] == k]
            gone = [p[2] for p in parents if p[0] == k and p[2] is not None]
            if not first or min(first) > at or gone and min(gone) <= at:
                out.append((field, seq, k))
    return sorted(out)


def test_against_brute_force_whole_and_in_batches(spark):
    for seed in range(3):
        rows, parents = random_case(seed)
        df, p = spark.createDataFrame(rows, REFS), spark.createDataFrame(parents, PARENTS)
        parent_rows = R.parent_rows(p, "p", "key", "at", "gone")
        want = brute(rows, parents)
        assert found(R.advance(None, refs_of(df), parent_rows)) == want
        # The same rows in batches of arbitrary cut: late parents retract, deletions reopen.
        n = (3, 5, 20)[seed]
        refs = refs_of(df).withColumn("batch", F.col("ingest_seq") % n)
        state = R.replay(refs, parent_rows.withColumn("batch", F.floor("first_at") * 7 % n), "batch", n)
        assert found(state) == want and state.watched().count() == refs.count()
        assert state.pending.count() <= len(want)


def test_waiting_resolved_and_reopened(spark):
    df = spark.createDataFrame([(1, ["a"], None, 5.0, ""), (2, ["b"], None, 12.0, "")], REFS)
    state = R.advance(None, refs_of(df), R.parent_rows(spark.createDataFrame([("a", 8.0, 25.0, "")], PARENTS), "p", "key", "at", "gone"))
    waits = lambda t: sorted(r.ref_key for r in state.waiting(t).collect())
    assert waits(6) == ["a"] and waits(9) == [] and waits(13) == ["b"] and waits(25) == ["a", "b"]
    rows = {(r.ref_field, r.period): r for r in R.snapshots(state, 10).collect()}
    assert rows[("many", 0)].n_later == 1 and rows[("many", 0)].n_resolved == 1 and rows[("many", 0)].n_waiting == 0
    assert rows[("many", 1)].n_never == 1 and rows[("many", 2)].n_reopened == 1 and rows[("many", 2)].n_waiting == 2


def test_empty_tables(spark):
    state = R.advance(None, refs_of(spark.createDataFrame([], REFS)), R.parent_rows(spark.createDataFrame([], PARENTS), "p", "key", "at", "gone"))
    assert found(state) == [] and R.snapshots(state).count() == 0


def test_one_key_with_a_third_of_all_rows(spark):
    df = spark.range(3000).selectExpr("id as ingest_seq", "cast(array() as array<string>) as keys", "if(id % 3 = 0, 'hot', concat('k', id)) as one", "cast(id as double) as at", "'' as kind")
    p = spark.createDataFrame([("hot", 1500.0, None, "")], PARENTS)
    state = R.advance(None, refs_of(df), R.parent_rows(p, "p", "key", "at", "gone"))
    assert state.orphans().count() == 2000 + 500
