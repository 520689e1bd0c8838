from __future__ import annotations

import random

import pytest

from chronomill.operators import hierarchy as H
from chronomill.plans import ledgers

SCHEMA = "ingest_seq bigint, memory_id string, supersedes string, depends_on array<string>, link string, node string"


def key(x):
    return (x or "").strip().lower() or None


def brute(rows, link):
    """Rows by walking up from each record, all ways, cycles found by reachability."""
    one = {}
    for r in sorted(rows, key=lambda r: r[0]):
        one.setdefault(r[1], r)
    up = {}
    for m, r in one.items():
        given = [r[2]] if link == "supersedes" else r[3] or []
        up[m] = {key(x) for x in given} & set(one)
    reach = {m: set(up[m]) for m in up}
    changed = True
    while changed:
        changed = False
        for m in reach:
            more = set().union(*[reach[p] for p in reach[m]], reach[m]) if reach[m] else set()
            if more != reach[m]:
                reach[m], changed = more, True
    cyclic = {m: min(x for x in reach[m] if m in reach[x]) for m in reach if m in reach[m]}
    memo = {}

    def walk(m):
        if m in cyclic:
            return {(cyclic[m], -1)}
        if m not in memo:
            memo[m] = {(r, d + 1 if d >= 0 else -1) for p in up[m] for r, d in walk(p)} if up[m] else {(m, 0)}
        return memo[m]

    return sorted((link, m, r, d) for m in up if up[m] for r, d in walk(m))


def graph(seed, n=60):
    rng = random.Random(seed)
    ids = [f"m{k:02d}" for k in range(n)]
    rows = []
    for k, m in enumerate(ids):
        near = ids[max(0, k - 6) : k + 2]
        pick = lambda: rng.choice([None, "", f" {rng.choice(near).upper()} ", rng.choice(near), rng.choice(ids[: k + 1]), "gone"])  # noqa: E731, B023
        rows.append((k, m, pick(), rng.choice([None, [], [pick() for _ in range(rng.randint(1, 3))]]), "x", "y"))
    rng.shuffle(rows)
    return rows + [(r[0] + 500, *r[1:]) for r in rows[:5]]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.walks(df, "memory_id", "ingest_seq", {"supersedes": "supersedes", "depends_on": "depends_on"}, **kw)
    return sorted(map(tuple, out.select("link", "node", "anc", "dist").collect()))


@pytest.mark.parametrize("seed,block,task", [(0, 1000, 10**6), (1, 8, 10**6), (2, 8, 4), (3, 1, 3), (4, 1, 10**6), (5, 4, 1)])
def test_against_brute_force(spark, seed, block, task):
    rows = graph(seed)
    assert run(spark, rows, block_rows=block, task_rows=task) == brute(rows, "depends_on") + brute(rows, "supersedes")


def test_long_chain_over_many_blocks(spark):
    rows = [(k, f"m{k:03d}", f"m{k - 1:03d}" if k else None, None, "", "") for k in range(120)]
    got = run(spark, rows, block_rows=2)
    assert got == [("supersedes", f"m{k:03d}", "m000", k) for k in range(1, 120)]


def test_cycle_across_blocks_and_below(spark):
    rows = [(k, f"m{k:02d}", f"m{(k + 1) % 20:02d}", None, "", "") for k in range(20)] + [(30, "z", "M07 ", None, "", ""), (31, "self", "self", None, "", "")]
    got = run(spark, rows, block_rows=3)
    assert got == sorted([("supersedes", f"m{k:02d}", "m00", -1) for k in range(20)] + [("supersedes", "z", "m00", -1), ("supersedes", "self", "self", -1)])


def test_cycle_across_blocks_with_other_parents(spark):
    up = {7: [8, 3], 8: [7], 6: [7], 5: [6], 12: [20, 1], 20: [12], 11: [12, 2], 21: [11], 22: [12], 30: [31], 31: [40, 9], 40: [30], 29: [30]}
    rows = [(k, f"m{k:02d}", None, [f"m{a:02d}" for a in up.get(k, [])], "", "") for k in range(45)]
    for block in (8, 1, 3, 100):
        assert run(spark, rows, block_rows=block) == brute(rows, "depends_on")


def test_paths_and_ancestors(spark):
    rows = [(0, "r", None, None, "", ""), (1, "a", "r", ["r"], "", ""), (2, "b", "a", ["a", "r"], "", ""), (3, "c", "b", ["b"], "", "")]
    for block in (1, 100):
        out = H.walks(spark.createDataFrame(rows, SCHEMA), "memory_id", "ingest_seq", {"supersedes": "supersedes", "depends_on": "depends_on"}, True, block)
        rows_ = {(r.link, r.node, r.anc, r.dist): (r.path, sorted(r.via)) for r in out.collect()}
        assert rows_[("supersedes", "c", "r", 3)] == (["c", "b", "a"], ["a", "b"])
        assert rows_[("depends_on", "c", "r", 2)][0] == ["c", "b"] and rows_[("depends_on", "c", "r", 3)][0] == ["c", "b", "a"]


def test_hot_parent_and_empty(spark):
    rows = [(0, "hub", None, None, "", "")] + [(k, f"x{k}", "hub", ["hub", "hub"], "", "") for k in range(1, 300)]
    assert len(run(spark, rows, block_rows=16)) == 2 * 299
    assert run(spark, []) == []


def closure(rows, link):
    """(ancestor, descendant) of two different records, by following the links until nothing is new."""
    ids, up = {r[1] for r in rows}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        up.setdefault(r[1], {key(x) for x in ([r[2]] if link == "supersedes" else r[3] or [])} & ids)
    found = set()
    for m in up:
        todo, seen = list(up[m]), set()
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += up[a]
        found |= {(link, a, m) for a in seen - {m}}
    return found


@pytest.mark.parametrize("seed,block", [(0, 1000), (1, 8), (2, 3), (3, 1), (4, 16)])
def test_descendants_through_cycles(spark, tmp_path, monkeypatch, seed, block):
    rows = graph(seed)
    if seed == 4:
        ring = {k: f"m{(k + 1) % 20:02d}" for k in range(20)}
        rows = [(k, f"m{k:02d}", ring.get(k, f"m{k - 7:02d}"), [ring.get(k, "m03"), "m44" if k == 5 else ""], "", "") for k in range(44)] + [(44, "m44", "m45", ["m45"], "", ""), (45, "m45", "", ["m45"], "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/memory_records_v1.parquet")
    walks = H.walks
    monkeypatch.setattr(H, "walks", lambda *a, **kw: walks(*a, block_rows=block, **kw))
    got = [tuple(r) for r in ledgers.p5_descendants(spark, str(tmp_path)).select("link", "memory_id", "descendant_id").collect()]
    assert len(got) == len(set(got)) and set(got) == closure(rows, "depends_on") | closure(rows, "supersedes")
