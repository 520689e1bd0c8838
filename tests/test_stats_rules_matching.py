from __future__ import annotations

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronomill.operators import assignment, matching, rules, stats
from chronomill.plans import evaluation


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5), (1, 5)]:
        for _ in range(20):
            cost = rng.integers(-9, 3, (n, m)).astype(float)
            got = sum(cost[i, j] for i, j in matching.assign(cost))
            small, large = min(n, m), max(n, m)
            c = cost if n <= m else cost.T
            assert got == min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))


def test_best_pairs(spark):
    df = spark.createDataFrame([("t", "g1", "c1", 4), ("t", "g1", "c2", 6), ("t", "g2", "c2", 5), ("u", "g", "c", 1)], "grp string, gold string, claim string, score int")
    assert sorted(map(tuple, matching.best_pairs(df, "grp", "gold", "claim", "score").collect())) == [("t", "g1", "c1", 4.0), ("t", "g2", "c2", 5.0), ("u", "g", "c", 1.0)]


def test_claims_of_one_artifact_far_apart_in_time(spark, data, tmp_path):
    one = spark.read.parquet(f"{data}/memory_records_v1.parquet").limit(1)
    rows = [(0, "g0", "alpha beta gamma", 499.0), (2, "g2", "alpha beta", 10.0), (1, "c1", "Alpha, beta, gamma", 501.0), (3, "c3", "alpha delta", 90000.0), (5, "c5", "omega", 12.0)]
    for k, m, statement, at in rows:
        at_ = {"ingest_seq": F.lit(k).cast("bigint"), "memory_id": F.lit(m), "statement": F.lit(statement), "observed_at": F.lit(at), "artifact_uri": F.lit("a.py")}
        one.withColumns(at_).write.mode("append").parquet(f"{tmp_path}/memory_records_v1.parquet")
    got = sorted(map(tuple, evaluation.claim_matching(spark, str(tmp_path)).collect()))
    assert got == [("a.py", "g0", "c1", 3.0), ("a.py", "g2", "c3", 1.0)]
    assert evaluation.claim_quality(spark, str(tmp_path)).first().matched == 2


def test_quality_of_an_artifact_too_large_for_a_matrix(spark, data, tmp_path):
    one = spark.read.parquet(f"{data}/memory_records_v1.parquet").limit(1)
    k = F.col("k")
    n = 2300
    twin = F.concat(F.lit("note about item"), F.floor(k / 2).cast("string"))  # 2j and 2j + 1 share one more word than any others
    at_ = {"ingest_seq": k, "memory_id": F.concat(F.lit("m"), k.cast("string")), "statement": twin, "observed_at": k.cast("double"), "artifact_uri": F.lit("a.py")}
    records = one.crossJoin(spark.range(n).select(F.col("id").alias("k"))).withColumns(at_).drop("k")
    records.unionByName(records.withColumn("ingest_seq", F.col("ingest_seq") + 2 * n)).write.parquet(f"{tmp_path}/memory_records_v1.parquet")
    assert (n // 2) ** 2 > matching.DENSE
    pairs = evaluation.claim_matching(spark, str(tmp_path)).collect()
    assert len(pairs) == n // 2 and all(int(r.claim_id[1:]) == int(r.gold_id[1:]) + 1 and r.score == 3.0 for r in pairs)
    quality = evaluation.claim_quality(spark, str(tmp_path))
    assert tuple(quality.first()) == (n // 2, 0, n // 2, 0, n // 2, 1.0, 1.0, 1.0, 0.0)
    plan = quality._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("artifact_type" in x for x in plan if "Relation" not in x)  # only what claims need is moved


def test_best_word_pairs_against_all_orders(spark):
    rng = random.Random(3)
    side = lambda p, n: [(g, f"{p}{k}", rng.sample("abcdef", rng.randint(0, 4))) for g in "xyz" for k in range(n)]
    l, r = side("l", 5), side("r", 6)
    a, b = (spark.createDataFrame(rows, f"g string, {n} string, w array<string>") for rows, n in ((l, "l"), (r, "r")))
    out = matching.best_word_pairs(a, b, "g", "l", "r", "w", "s").collect()
    for g in "xyz":
        left, right = ([set(w) for x, _, w in rows if x == g] for rows in (l, r))
        best = max(sum(len(w & right[j]) for w, j in zip(left, p, strict=True)) for p in itertools.permutations(range(6), 5))
        mine = [x for x in out if x.g == g]
        assert sum(x.s for x in mine) == best and len({x.l for x in mine}) == len({x.r for x in mine}) == len(mine)


def _claims(rng, sizes, vocabulary):
    weights = [1 / (k + 1) for k in range(vocabulary)]
    rows = [(k, f"{k}-{i:05d}", list(dict.fromkeys(f"w{x}" for x in rng.choices(range(vocabulary), weights, k=rng.randint(1, 12))))) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.list_(pa.string())), strict=True)]


@pytest.mark.parametrize("limits", [{}, {"COLUMNS": 2, "CELLS": 50, "FOUND": 1, "KEPT": 50}])
def test_word_pairs_of_a_large_group_have_the_total_of_the_matrix(monkeypatch, limits):
    rng = random.Random(7)
    for k, v in limits.items():
        monkeypatch.setattr(assignment, k, v)
    for sizes in [(1, 1), (1, 40), (40, 3), (60, 60), (50, 60), (300, 280)]:
        for vocabulary in (3, 30, 400):
            claims = _claims(rng, sizes, vocabulary)
            words = {i: set(w) for i, w in zip(*(c.to_pylist() for c in claims[1:]), strict=True)}
            monkeypatch.setattr(matching, "DENSE", 1 << 20)
            dense = matching.word_pairs(*claims)
            monkeypatch.setattr(matching, "DENSE", 0)
            a, b, w = (c.to_pylist() for c in matching.word_pairs(*claims))
            assert sum(w) == sum(dense[2].to_pylist())
            assert len(set(a)) == len(set(b)) == len(a) and all(len(words[i] & words[j]) == n > 0 for i, j, n in zip(a, b, w, strict=True))


def test_word_pairs_of_a_large_group_make_no_matrix():
    claims = _claims(random.Random(5), (6000, 6000), 3000)
    tracemalloc.start()
    a, _, w = matching.word_pairs(*claims)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) > 5000 and sum(w.to_pylist()) > 10_000
    assert peak < 2 * 6000 * 6000  # a matrix has four bytes a pair


def test_confusion_and_quality(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, False)] * 4 + [(False, True)] * 2 + [(False, None)], "t boolean, p boolean")
    r = stats.quality(stats.confusion(df, [], F.col("t"), F.col("p"))).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.abstained) == (3, 1, 4, 2, 1)
    assert (r.precision, r.recall, r.f1, r.coverage) == (0.6, 0.75, round(2 * 0.6 * 0.75 / 1.35, 6), round(10 / 11, 6))
    assert stats.confusion(df.limit(0), ["t"], F.col("t"), F.col("p")).count() == 0


def test_kappa(spark):
    same = spark.createDataFrame([("a", "a")] * 4, "x string, y string")
    assert stats.kappa(same, "x", "y").first().kappa == 1.0
    half = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "b"), ("b", "a")], "x string, y string")
    r = stats.kappa(half, "x", "y").first()
    assert (r.agreement, r.kappa) == (0.5, 0.0)
    assert stats.kappa(same.limit(0), "x", "y").first().n == 0


def test_ratio_texts_and_distribution(spark):
    df = spark.createDataFrame([("1/3",), ("1/3",), ("bad",), (None,)], "r string")
    a, b, p = stats.pooled_ratio("r")
    assert tuple(df.select(a, b, p).first()) == (2, 6, 33.3)
    assert [tuple(r) for r in stats.distribution(df, "r").collect()][0] == ("1/3", 2, 50.0)


def test_bootstrap_is_stable_and_close(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 2 as double) as v")
    a = stats.bootstrap_interval(df, "id", "v", 300).first()
    b = stats.bootstrap_interval(df.repartition(7), "id", "v", 300).first()
    assert a == b and abs(a.resampled_mean - 0.5) < 0.02 and 0.43 < a.ci_low < 0.47 and 0.53 < a.ci_high < 0.57


def test_capped_and_pooled(spark):
    df = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 1)], "g string, k int")
    assert stats.capped(df, ["g"], [F.asc("k")], 3).count() == 4
    r = stats.pooled(spark.createDataFrame([(1, 1, 2, 1, 3)], "mr int, mo int, r int, o int, c int"), "mr", "mo", "r", "o", "c").first()
    assert (r.recall, r.precision, r.optional_discovery) == (0.5, round(2 / 3, 6), 1.0)


def test_first_match_and_gates(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    c = rules.first_match([("small", F.col("x") < 3), ("any", F.col("x") < 9)], "none")
    assert [r[0] for r in df.select(c).collect()] == ["small", "any", "none"]
    e = spark.createDataFrame([("t", "a", "PASS"), ("t", "b", "GEN"), ("u", "a", "PASS"), ("v", "a", "FAIL"), ("v", "b", "PASS"), ("w", "a", "STALE_AUDIT"), ("w", "b", "FAIL")], "s string, g string, st string")
    got = {r.s: r.verdict for r in rules.gates(e, "s", "g", "st", ["a", "b"], {"b": ["GEN"]}).collect()}
    assert got == {"t": "PASS", "u": "NOT_EXECUTED", "v": "FAIL", "w": "STALE_AUDIT"}


@pytest.mark.parametrize(
    "log,kind",
    [("X is Deprecated", "DEPRECATION_WARNING"), ("ImportError: y", "IMPORT_FAILURE"), ("AttributeError", "API_ABSENT"), ("TypeError: missing 1", "SIGNATURE_MISMATCH"), ("TypeError", "TEST_EXPECTATION_ONLY"), ("AssertionError", "BEHAVIOR_MISMATCH"), ("bwrap: no", "ENVIRONMENT_FAILURE"), (None, "TEST_EXPECTATION_ONLY")],
)
def test_failure_kinds(spark, log, kind):
    df = spark.createDataFrame([(log,)], "l string")
    assert df.select(rules.failure_kind(F.lit(False), F.col("l"))).first()[0] == kind
    assert df.select(rules.failure_kind(F.lit(True), F.col("l"))).first()[0] == "NONE"


def test_attribution_order(spark):
    def judge(commit, art, sym, stmt, diff="", rep=""):
        df = spark.createDataFrame([((commit, art, sym, stmt), ("abc123", "src/a.py", "m.K.f", rep), diff)], "c struct<evidence_commit:string,artifact_uri:string,symbol:string,statement:string>, g struct<target_commit:string,artifact_uri:string,symbol:string,replacement_symbol:string>, d string")
        return df.select(rules.attribution("c", "g", F.col("d"))).first()[0]

    assert judge(None, "a.py", "f", "f is deprecated") == "MISSING_COMMIT_ATTRIBUTION"
    assert judge("zzz", "a.py", "f", "f is deprecated") == "WRONG_COMMIT"
    assert judge("abc", "b.py", "f", "f is deprecated") == "WRONG_ARTIFACT"
    assert judge("abc", "x/a.py", "other", "text") == "UNSUPPORTED"
    assert judge("abc", "x/a.py", "f()", "f was removed") == "SUPPORTED"
    assert judge("abc", "x/a.py", "f", "f exists") == "PARTIAL"
    assert judge("abc", "x/a.py", "f", "use g instead of f", "def g(): f", "n.g") == "SUPPORTED"


def test_differences(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "p string, d string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4"), ("z", None)], "p string, d string")
    assert sorted(map(tuple, matching.tree_difference(a, b, ["p"], "d").collect())) == [("w", "EXTRA"), ("y", "SHA_MISMATCH")]
    assert [tuple(r) for r in matching.field_differences(a, b, "p", ["d"]).collect()] == [("y", "d", "2", "3")]
    assert sorted(map(tuple, matching.overlay(a, b, "p").collect()), key=repr) == sorted([("x", "1"), ("y", "3"), ("z", None), ("w", "4")], key=repr)
