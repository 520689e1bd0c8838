from __future__ import annotations

import random

import pytest

from chronomill.operators.asof import as_known

EVENTS = "event_id bigint, rid string, as_of bigint, task string, _entity string, at string"
WRITES = "ingest_seq bigint, id string, created_at bigint, scope string, task string"


def run(spark, events, writes, **kw):
    out = as_known(
        spark.createDataFrame(events, EVENTS), spark.createDataFrame(writes, WRITES), "event_id", "rid", "as_of", {"task": "task"}, "id", "created_at", "ingest_seq",
        {"scope": "scope", "their_task": "task"}, **kw,
    )
    return sorted(((r.event_id, r._write_seq, r._write_at, r.scope) for r in out.collect()), key=repr)


def brute(events, writes):
    out = set()
    for e in events:
        k = (e[1] or "").strip().lower()
        if not k or e[2] is None:
            continue
        w = [w for w in writes if w[1] == k and w[2] is not None and w[2] <= e[2]]
        if w:
            b = max(w, key=lambda w: (w[2], w[0]))
            out.add((e[0], b[0], b[2], b[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("runs", [1, 15])
def test_against_brute_force(spark, seed, runs):
    rng = random.Random(seed)
    ids = ["hot"] * 5 + [f"r{k}" for k in range(9)]
    writes = [(n, rng.choice(ids), rng.choice([rng.randint(0, 100), rng.randint(0, 100), None]), rng.choice(["g", None]), "t") for n in range(120)]
    noisy = lambda k: rng.choice([k, f" {k.upper()} ", None, "", "unknown"])
    events = [(n, noisy(rng.choice(ids)), rng.choice([rng.randint(-5, 130), None]) if n % 9 == 0 else rng.randint(-5, 130), "t", "c", "c") for n in range(150)]
    events += events[:30]
    assert run(spark, events, writes, runs=runs) == brute(events, writes)


def test_one_entity_over_many_runs(spark):
    """Few writes and very many events, most of them in runs without a write."""
    writes = [(n, "hot", t, f"g{n}", "t") for n, t in enumerate((500, 100, 500, 2900))]
    events = [(n, "hot", n, "t", "", "") for n in range(3000)]
    assert run(spark, events, writes, runs=20) == brute(events, writes)


def test_empty_sides_and_null_keys(spark):
    w = [(1, "a", 5, "g", "t")]
    assert run(spark, [], w) == [] and run(spark, [(1, "a", 9, "t", "", "")], []) == []
    assert len(run(spark, [(None, "a", 9, "t", "", ""), (None, "a", 7, "t", "", "")], w)) == 2
