from __future__ import annotations

import random

import pytest

from chronomill.operators import store

V1 = "ingest_seq bigint, memory_id string, valid_from double, valid_to double, supersedes string, depends_on array<string>, status string, role_tags array<string>"
INF = float("inf")


def rec(seq, name, start, supersedes=None, depends=(), status="ACTIVE", end=INF):
    return (seq, name, float(start), end, supersedes, list(depends), status, [])


def replayed(rows):
    """One record at a time, in order of arrival."""
    state = {}

    def spread(name, tick, seen):
        if name in seen:
            return
        seen.add(name)
        for n in list(state):
            r = state[n]
            if name in r["depends"] and r["status"] == "ACTIVE":
                r["status"], r["end"] = "SUPERSEDED", min(r["end"], tick)
                spread(n, tick, seen)

    for seq, name, start, end, sup, dep, status, _ in sorted(rows):
        state[name] = {"status": status, "end": end, "depends": dep}
        if sup in state:
            state[sup]["status"], state[sup]["end"] = "SUPERSEDED", min(state[sup]["end"], start)
            spread(sup, start, set())
    return {n: (r["status"], r["end"]) for n, r in state.items()}


def run(spark, rows, f=store.propagated):
    df = f(store.deliveries(spark.createDataFrame(rows, V1)))
    return {r.memory_id: (r.status, r.valid_to) for r in df.collect()}


CASES = {
    "two hops": ([rec(1, "m1", 10), rec(2, "m2", 20, "m1")], {"m1": ("SUPERSEDED", 20.0), "m2": ("ACTIVE", INF)}),
    "many hops": ([rec(1, "m1", 10), rec(2, "m2", 20, "m1"), rec(3, "m3", 30, "m2")], {"m1": ("SUPERSEDED", 20.0), "m2": ("SUPERSEDED", 30.0), "m3": ("ACTIVE", INF)}),
    "dependant": ([rec(1, "p", 1), rec(2, "c", 2, None, ["p"]), rec(3, "n", 25, "p")], {"p": ("SUPERSEDED", 25.0), "c": ("SUPERSEDED", 25.0), "n": ("ACTIVE", INF)}),
    "two parents": ([rec(1, "a", 1), rec(2, "b", 1), rec(3, "c", 1, None, ["a", "b"]), rec(4, "n", 9, "a")], {"a": ("SUPERSEDED", 9.0), "b": ("ACTIVE", INF), "c": ("SUPERSEDED", 9.0), "n": ("ACTIVE", INF)}),
    "cycle": ([rec(1, "a", 1, None, ["b"]), rec(2, "b", 1, None, ["a"]), rec(3, "n", 7, "a")], {"a": ("SUPERSEDED", 7.0), "b": ("SUPERSEDED", 7.0), "n": ("ACTIVE", INF)}),
    "late target": ([rec(1, "n", 7, "p"), rec(2, "p", 1)], {"n": ("ACTIVE", INF), "p": ("ACTIVE", INF)}),
    "late dependant": ([rec(1, "p", 1), rec(2, "n", 7, "p"), rec(3, "c", 8, None, ["p"])], {"p": ("SUPERSEDED", 7.0), "n": ("ACTIVE", INF), "c": ("ACTIVE", INF)}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, want = CASES[name]
    assert run(spark, rows) == want == replayed(rows)


@pytest.mark.parametrize("seed", range(4))
def test_propagation_is_the_replay(spark, seed):
    rng = random.Random(seed)
    names = [f"m{k}" for k in range(25)]
    order = names[:]
    rng.shuffle(order)
    rows = [
        rec(k + 1, n, rng.randint(1, 50), rng.choice([None, None, rng.choice(names)]), rng.sample(names, rng.randint(0, 2)), rng.choice(["ACTIVE", "ACTIVE", "DISPUTED"]), rng.choice([INF, 40.0]))
        for k, n in enumerate(order)
    ]
    assert run(spark, rows) == replayed(rows)


W = "ingest_seq bigint, id string, task_scope string, type string, statement string, evidence_ids array<string>, created_at bigint, valid_from bigint, valid_to bigint, supersedes string, status string, role_tags array<string>, artifact_hash string"


def writes(seed, n=120):
    rng = random.Random(seed)
    ids = [f"r{k}" for k in range(15)]
    return [(k, rng.choice(ids), None, None, "s", None, rng.randint(0, 99), None, rng.choice([None, rng.randint(0, 120)]), rng.choice([None, "", rng.choice(ids), f" {rng.choice(ids).upper()} "]), "ACTIVE", None, None) for k in range(n)]


def sequential(rows):
    table = {}
    for r in rows:
        target = (r[9] or "").strip().lower()
        if target in table and table[target][0] > r[6]:
            table[target] = (r[6], "SUPERSEDED")
        table[r[1]] = (999999999 if r[8] is None else r[8], "ACTIVE")
    return table


@pytest.mark.parametrize("seed", range(3))
def test_replay_whole_and_in_batches(spark, seed):
    rows = writes(seed)
    df = store.written(spark.createDataFrame(rows, W))
    got = lambda d: {r.id: (r.valid_to, r.status) for r in d.collect()}
    assert got(store.replay(df)) == sequential(rows)
    state = None
    for k in range(3):
        state = store.fold(state, df.where(f"ingest_seq div 40 = {k}"))
    assert got(state) == sequential(rows)


def test_ids_and_defaults(spark):
    import hashlib

    row = store.written(spark.createDataFrame([(1, None, None, None, "abc", None, 7, None, None, " ", None, None, None)], W)).first()
    assert row.id == "mem_" + hashlib.md5(b"abc7").hexdigest()[:8]
    assert (row.task_scope, row.valid_from, row.valid_to, row.supersedes, row.status) == ("global", 7, 999999999, None, "ACTIVE")


def test_artifacts(spark):
    import hashlib

    sha = hashlib.sha256(b"x = 1\n").hexdigest()
    files = spark.createDataFrame([("a.py", "x = 1\n"), ("gone.py", None)], "path string, content string")
    r = spark.createDataFrame(
        [("same", "a.py", sha, None, None), ("other", "a.py", "0" * 64, None, None), ("gone", "gone.py", sha, None, None), ("free", "b.py", None, None, None), ("none", None, sha, "q", "d"), ("sym", "a.py", "0" * 64, "K.x", "D"), ("lost", "a.py", sha, "K.y", "D")],
        "memory_id string, artifact_uri string, artifact_digest string, symbol_qualified_name string, symbol_digest string",
    )
    got = {x.memory_id: x.artifact_valid for x in store.artifact_valid(r, files).collect()}
    assert got == {"same": True, "other": False, "gone": False, "free": True, "none": True, "sym": False, "lost": True}
    symbols = spark.createDataFrame([("a.py", "x", "D")], "path string, qualified_name string, symbol_digest string")
    got = {x.memory_id: x.symbol_valid for x in store.symbol_valid(r, files, symbols).collect()}
    assert got == {"same": True, "other": False, "gone": False, "free": True, "none": True, "sym": True, "lost": False}
