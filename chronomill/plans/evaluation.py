"""Evaluation queries on agent events: rates, confusion, agreement, intervals, pooling, samples, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import table
from chronomill.operators import matching, rules, stats
from chronomill.plans import sql
from chronomill.plans.store import v1_records

RESAMPLES = 200


def events(spark: SparkSession, d: str) -> DataFrame:
    """Agent events, each once, with flags: passed, stale use, usable latency, and a seed of three."""
    e = table(spark, d, "episode_events").dropDuplicates(["event_id"])
    return e.select(
        "*",
        (F.col("status") == "PASSED").alias("passed"),
        (F.col("category") == "stale_evidence").alias("is_stale"),
        F.when(F.col("latency_ms") >= 0, F.col("latency_ms")).alias("latency"),
        F.pmod("event_id", F.lit(3)).alias("seed"),
    )


def success_by_method(spark: SparkSession, d: str) -> DataFrame:
    return stats.success_rates(events(spark, d), ["method"], F.col("passed"), F.col("stale_used"), F.col("latency"))


def _confusion(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    return stats.confusion(events(spark, d), by, F.col("is_stale"), F.col("stale_used"))


def confusion_by_method(spark: SparkSession, d: str) -> DataFrame:
    return stats.quality(_confusion(spark, d, ["method"]))


def validity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.validity(events(spark, d).where("category is not null and stale_used is not null"), ~F.col("is_stale"), ~F.col("stale_used"))


def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per category and in total (null category_group)."""
    e = events(spark, d).where("stale_used is not null").withColumn("category_group", F.coalesce("category", F.lit("none")))
    hit = F.count_if(F.coalesce("is_stale", F.lit(False)) == F.col("stale_used"))
    g = e.rollup("category_group").agg(F.count("*").alias("total"), hit.alias("n_correct"))
    return g.withColumn("accuracy", F.round(stats.ratio(F.col("n_correct"), F.col("total")), 6))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "memory_records").where("status is not null")
    label = F.upper(F.trim("status"))
    return r.groupBy("id").agg(F.min_by(label, "ingest_seq").alias("label_a"), F.max_by(label, "ingest_seq").alias("label_b"))


def label_kappa(spark: SparkSession, d: str) -> DataFrame:
    return stats.kappa(_labels(spark, d), "label_a", "label_b")


def _per_task(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("task_id is not null")
    rate = lambda m: stats.ratio(F.count_if((F.col("method") == m) & F.col("passed")), F.count_if(F.col("method") == m), True)
    g = e.groupBy("task_id").agg(rate("full").alias("tsr_full"), rate("no_validity").alias("tsr_other"))
    return g.where("tsr_full is not null and tsr_other is not null").withColumn("diff", F.col("tsr_full") - F.col("tsr_other"))


def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    return _per_task(spark, d).select("task_id", F.round("tsr_full", 6).alias("tsr_full"), F.round("tsr_other", 6).alias("tsr_other"), F.round("diff", 6).alias("diff"))


def bootstrap_difference(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_interval(_per_task(spark, d), "task_id", "diff", RESAMPLES)


def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    per = events(spark, d).where("method is not null").groupBy("method", "seed").agg(F.avg(F.col("passed").cast("int")).alias("tsr"))
    return per.groupBy("method").agg(F.round(F.avg("tsr"), 6).alias("mean_tsr"), F.round(F.stddev_pop("tsr"), 6).alias("std_tsr"), F.round(F.max("tsr"), 6).alias("best_tsr"))


def ratio_pooling(spark: SparkSession, d: str) -> DataFrame:
    text = events(spark, d).where("task_id is not null").groupBy("task_id", "method").agg(
        F.concat(F.count_if("passed").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("tsr_text")
    )
    a, b, pct = stats.pooled_ratio("tsr_text")
    return text.groupBy("method").agg(a.alias("n_passed"), b.alias("n_runs"), pct.alias("pct"))


def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(table(spark, d, "memory_records").withColumn("status_name", F.upper(F.trim("status"))), "status_name")


def group_maximum(spark: SparkSession, d: str) -> DataFrame:
    """Events per family and category, and the largest category of each family."""
    g = events(spark, d).groupBy("family", "category").agg(F.count("*").alias("n"))
    return g.groupBy("family").agg(F.sum("n").alias("n_events"), F.max("n").alias("n_largest"), F.countDistinct("category").alias("n_categories"))


def group_names(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of evidence per kind of artifact as one text, the longest lists first."""
    v = v1_records(spark, d).where("artifact_type is not null and evidence_type is not null")
    g = v.groupBy("artifact_type").agg(F.sort_array(F.collect_set("evidence_type")).alias("_k"))
    return g.select("artifact_type", F.size("_k").alias("n_kinds"), F.array_join("_k", ", ").alias("kinds")).orderBy(F.desc("n_kinds"), "artifact_type")


def check_matrix(spark: SparkSession, d: str) -> DataFrame:
    v = v1_records(spark, d)
    checks = {
        "has_statement": F.col("statement").rlike(r"[\p{L}\p{N}]"), "has_artifact": F.col("artifact_uri") != "", "has_symbol": F.col("symbol_qualified_name") != "",
        "has_digest": F.col("artifact_digest") != "", "is_closed": F.col("valid_to") < float("inf"),
    }
    return v.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in checks.items()])


def kill_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per task, the share of stale cases whose run failed, and whether at least four fifths did."""
    g = events(spark, d).where("task_id is not null").groupBy("task_id").agg(F.count_if("is_stale").alias("n_invalid"), F.count_if(F.col("is_stale") & ~F.col("passed")).alias("n_killed"))
    r = stats.ratio(F.col("n_killed"), F.col("n_invalid"))
    return g.select("*", F.round(r, 6).alias("kill_rate"), (r >= 0.8).alias("strong"))


def condition_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Success rate per task and condition side by side, the lift of one over another, and the best of all."""
    e = events(spark, d).where("task_id is not null")
    p = e.groupBy("task_id").pivot("method", ["full", "bm25", "no_validity"]).agg(F.round(F.avg(F.col("passed").cast("int")), 6))
    return p.select("task_id", F.col("full").alias("tsr_full"), F.col("bm25").alias("tsr_bm25"), F.col("no_validity").alias("tsr_no_validity")).withColumns(
        {"lift": F.round(F.col("tsr_full") - F.col("tsr_bm25"), 6), "degradation": F.round(F.col("tsr_full") - F.col("tsr_no_validity"), 6), "best": F.greatest("tsr_full", "tsr_bm25", "tsr_no_validity")}
    )


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(F.countDistinct("task_id").alias("n_tasks"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("family", "method").alias("n_pairs"))


def approximate_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(F.approx_count_distinct("task_id", 0.02).alias("n_tasks"), F.approx_count_distinct("record_id", 0.02).alias("n_records"))


def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    """Records against their task's description: two shared words make a hit; recall is capped at one."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    truth = table(spark, d, "task_environments").groupBy(F.col("task_id").alias("task_scope")).agg(F.min("description").alias("_d"))
    recs = table(spark, d, "memory_records").groupBy("id").agg(F.min_by(F.struct("task_scope", "statement", "type", "artifact_hash"), "ingest_seq").alias("_r")).select("id", "_r.*")
    j = recs.join(truth, "task_scope")
    hit = F.size(F.array_intersect(words(F.coalesce("statement", F.lit(""))), words(F.coalesce("_d", F.lit(""))))) >= 2
    g = j.groupBy("task_scope").agg(F.count("*").alias("n_extracted"), F.count_if(hit).alias("n_hits"), F.count_if(F.col("artifact_hash") != "").alias("n_attributed"))
    return g.select(
        "task_scope", "n_extracted", "n_hits", F.round(stats.ratio(F.col("n_hits"), F.col("n_extracted")), 6).alias("precision"),
        F.least(F.lit(1.0), F.col("n_hits").cast("double")).alias("recall"), F.round(stats.ratio(F.col("n_attributed"), F.col("n_extracted")), 6).alias("attribution"),
    )


def gate_reduction(spark: SparkSession, d: str) -> DataFrame:
    """All and any of each task's runs; null flags fail."""
    ok = F.coalesce("passed", F.lit(False))
    return events(spark, d).where("task_id is not null").groupBy("task_id").agg(
        F.bool_and(ok).alias("all_passed"), F.bool_or(ok).alias("any_passed"), F.bool_or(F.coalesce("stale_used", F.lit(False))).alias("any_stale"), F.count_if(ok).alias("n_passed")
    )


GATES = ("causal", "semantic", "leakage", "controls")


def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of four gates per record, pivoted and judged, missing evidence failing closed."""
    e = table(spark, d, "evidence").groupBy("evidence_id").agg(F.min("recorded_at").alias("_at"), F.min("deleted_at").alias("_gone"))
    slot = F.pmod("_at", F.lit(5))
    gate = F.element_at(F.array(*[F.lit(g) for g in GATES]), (F.pmod("_at", F.lit(4)) + 1).cast("int"))
    status = F.when(F.col("_gone").isNotNull(), "STALE_AUDIT").when(slot == 0, "FAIL").when(slot == 1, "GENERATED").otherwise("PASS")
    rows = e.where("_at is not null").select(F.floor(F.col("_at") / 100).cast("bigint").alias("subject"), gate.alias("gate"), status.alias("status"))
    return rules.gates(rows, "subject", "gate", "status", GATES, {"controls": ("GENERATED",)})


def capped_sample(spark: SparkSession, d: str) -> DataFrame:
    """The three oldest records of each artifact."""
    return stats.capped(v1_records(spark, d).where("artifact_uri is not null"), ["artifact_uri"], [F.asc("ingest_seq")], 3).select("artifact_uri", "memory_id", "place")


def labelled_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most three active and two superseded records of each artifact, twenty in all."""
    v = v1_records(spark, d).where("artifact_uri is not null")
    picked = stats.capped_by_label(v, ["artifact_uri"], "status", {"ACTIVE": 3, "SUPERSEDED": 2}, [F.asc("ingest_seq")], 20)
    return picked.select("artifact_uri", "memory_id", "status", "place")


def audit_counters(spark: SparkSession, d: str) -> DataFrame:
    """Reasons why documents would be rejected, counted."""
    t = F.coalesce("text", F.lit(""))
    reason = rules.first_match([("EMPTY", F.trim(t) == ""), ("NO_LANGUAGE", F.col("lang").isNull()), ("NOT_CAPTURED", F.col("captured_at").isNull()), ("TOO_LONG", F.length(t) > 10_000)], "ACCEPTED")
    return table(spark, d, "documents").groupBy(reason.alias("reason"), "doc_kind").agg(F.count("*").alias("n"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Records at their first delivery, of what claims need."""
    one = F.min_by(F.struct("artifact_uri", "observed_at", "statement"), "ingest_seq").alias("_r")
    v = table(spark, d, "memory_records_v1").where("memory_id <> ''").groupBy("memory_id").agg(F.min("ingest_seq").alias("ingest_seq"), one)
    return v.select("memory_id", "ingest_seq", "_r.*").where("artifact_uri <> '' and observed_at is not null")


def claim_matching(spark: SparkSession, d: str) -> DataFrame:
    """Records with even sequence as gold and odd as generated claims of one artifact, matched one to one."""
    words = F.array_distinct(F.filter(F.split(F.lower("statement"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 2))
    v = _claims(spark, d).select(F.col("artifact_uri").alias("claim_group"), F.pmod("ingest_seq", F.lit(2)).alias("side"), "memory_id", words.alias("words"))
    return matching.best_side_pairs(v, "claim_group", "side", "memory_id", "words", "gold_id", "claim_id", "score")


def claim_quality(spark: SparkSession, d: str) -> DataFrame:
    v = _claims(spark, d)
    zero, even = F.lit(0).cast("bigint"), (F.pmod("ingest_seq", F.lit(2)) == 0).cast("bigint")
    claims = v.select(zero.alias("matched"), zero.alias("matched_optional"), even.alias("required"), zero.alias("optional"), (1 - even).alias("claims"))
    row = claims.unionByName(claim_matching(spark, d).select(F.lit(1).cast("bigint").alias("matched"), *[zero.alias(c) for c in claims.columns[1:]]))
    return stats.pooled(row, "matched", "matched_optional", "required", "optional", "claims")


QUERIES = {
    k: globals()[k]
    for k in (
        "success_by_method", "confusion_by_method", "validity_metrics", "accuracy_rollup", "label_kappa", "paired_difference", "bootstrap_difference",
        "seed_spread", "ratio_pooling", "status_distribution", "group_maximum", "group_names", "check_matrix", "kill_rate", "condition_pivot",
        "distinct_counts", "approximate_counts", "extraction_quality", "gate_reduction", "gate_verdicts", "capped_sample", "labelled_sample", "audit_counters",
        "claim_matching", "claim_quality",
    )
}

_E = """with e as (
  select *, status = 'PASSED' as passed, category = 'stale_evidence' as is_stale, case when latency_ms >= 0 then latency_ms end as latency, event_id % 3 as seed
  from (select distinct * from episode_events)
)"""
_R = lambda a, b, k=6: f"round(coalesce(({a})::double / nullif(({b})::double, 0), 0), {k})"
_TASKS = """, pt as (select task_id,
    count(*) filter (method = 'full' and passed)::double / nullif(count(*) filter (method = 'full'), 0) as tsr_full,
    count(*) filter (method = 'no_validity' and passed)::double / nullif(count(*) filter (method = 'no_validity'), 0) as tsr_other
  from e where task_id is not null group by 1),
pd as (select *, tsr_full - tsr_other as diff from pt where tsr_full is not null and tsr_other is not null)"""

ORACLES = {
    "success_by_method": _E
    + f" select method, count(*) as total, count(*) filter (passed) as n_passed, {_R('count(*) filter (passed)', 'count(*)', 4)} as tsr, count(*) filter (stale_used) as n_stale,"
    + f" {_R('count(*) filter (stale_used)', 'count(*)', 4)} as stale_rate, round(avg(latency), 2) as avg_latency_ms from e group by 1",
    "confusion_by_method": _E
    + f""", c as (select method, count(*) filter (is_stale and stale_used) as tp, count(*) filter (not is_stale and not stale_used) as tn,
  count(*) filter (not is_stale and stale_used) as fp, count(*) filter (is_stale and not stale_used) as fn, count(*) filter (stale_used is null) as abstained
  from e where is_stale is not null group by 1)
select *, {_R('tp+tn+fp+fn', 'tp+tn+fp+fn+abstained')} as coverage, {_R('tp+tn', 'tp+tn+fp+fn')} as accuracy_decided, {_R('tp+tn', 'tp+tn+fp+fn+abstained')} as accuracy_overall,
  {_R('tp', 'tp+fp')} as precision, {_R('tp', 'tp+fn')} as recall, {_R('2*tp', '2*tp+fp+fn')} as f1, {_R('fp', 'fp+tn')} as false_invalidation_rate,
  {_R('fn', 'fn+tp')} as stale_exposure_rate, {_R('tn', 'fp+tn')} as valid_recall from c""",
    "validity_metrics": _E
    + f""", v as (select not is_stale as valid, not stale_used as active from e where category is not null and stale_used is not null),
g as (select count(*) as n, count(*) filter (valid) as nv, count(*) filter (not valid) as ns, count(*) filter (active) as na, count(*) filter (valid and not active) as fi,
  count(*) filter (valid and active) as k, count(*) filter (not valid and active) as se, count(*) filter (not valid and not active) as dr from v)
select n as total_samples, nv as total_valid, ns as total_stale, na as total_active, fi as false_invalidations, {_R('fi', 'nv')} as false_invalidation_rate, {_R('k', 'nv')} as valid_recall,
  se as stale_exposures, {_R('se', 'ns')} as stale_exposure_rate, {_R('dr', 'ns')} as stale_recall from g""",
    "accuracy_rollup": _E
    + f""", x as (select coalesce(category, 'none') as category_group, coalesce(is_stale, false) = stale_used as hit from e where stale_used is not null)
select category_group, count(*) as total, count(*) filter (hit) as n_correct, {_R('count(*) filter (hit)', 'count(*)')} as accuracy from x group by rollup (category_group)""",
    "label_kappa": """with l as (select id, arg_min(upper(trim(status)), ingest_seq) as a, arg_max(upper(trim(status)), ingest_seq) as b from memory_records where status is not null group by 1),
m as (select coalesce(x.l, y.l) as l, coalesce(x.n, 0) as na, coalesce(y.n, 0) as nb from (select a as l, count(*) as n from l group by 1) x full join (select b as l, count(*) as n from l group by 1) y on x.l = y.l),
s as (select count(*)::double as n, (count(*) filter (a = b))::double / count(*) as po, (select sum(na::double * nb) from m) / (count(*)::double * count(*)) as pe from l)
select n::bigint as n, round(po, 6) as agreement, round(case when pe >= 1 then 1.0 else (po - pe) / (1 - pe) end, 6) as kappa from s""",
    "paired_difference": _E + _TASKS + " select task_id, round(tsr_full, 6) as tsr_full, round(tsr_other, 6) as tsr_other, round(diff, 6) as diff from pd",
    "bootstrap_difference": _E
    + _TASKS
    + f""", dr as (select diff, r, ('0x' || left(md5(task_id || '-' || r), 8))::bigint::double / 4294967296.0::double as u from pd, unnest(range(0, {RESAMPLES})) as x(r)),
w as (select diff, r, {' + '.join(f'(u >= {p}::double)::int' for p in stats._POISSON)} as c from dr),
m as (select r, sum(c * diff) / sum(c) as m from w group by 1)
select round(quantile_cont(m, 0.025), 4) as ci_low, round(quantile_cont(m, 0.975), 4) as ci_high, round(avg(m), 4) as resampled_mean from m""",
    "seed_spread": _E
    + """, p as (select method, seed, avg(passed::int) as tsr from e where method is not null group by all)
select method, round(avg(tsr), 6) as mean_tsr, round(stddev_pop(tsr), 6) as std_tsr, round(max(tsr), 6) as best_tsr from p group by 1""",
    "ratio_pooling": _E
    + """, t as (select task_id, method, count(*) filter (passed) || '/' || count(*) as x from e where task_id is not null group by all)
select method, sum(split_part(x, '/', 1)::bigint)::bigint as n_passed, sum(split_part(x, '/', 2)::bigint)::bigint as n_runs, round(100 * sum(split_part(x, '/', 1)::bigint)::double / sum(split_part(x, '/', 2)::bigint), 1) as pct from t group by 1""",
    "status_distribution": "select upper(trim(status)) as status_name, count(*) as n, round(100 * count(*)::double / sum(count(*)) over (), 2) as pct from memory_records group by 1",
    "group_maximum": _E + ", g as (select family, category, count(*) as n from e group by all) select family, sum(n)::bigint as n_events, max(n) as n_largest, count(distinct category) as n_categories from g group by 1",
    "group_names": f"with {sql.DELIVERIES}, k as (select distinct artifact_type, evidence_type from d where artifact_type is not null and evidence_type is not null) select artifact_type, count(*) as n_kinds, string_agg(evidence_type, ', ' order by evidence_type) as kinds from k group by 1",
    "check_matrix": f"""with {sql.DELIVERIES} select count(*) as total, count(*) filter (regexp_matches(statement, '[\\p{{L}}\\p{{N}}]')) as has_statement, count(*) filter (artifact_uri <> '') as has_artifact,
  count(*) filter (symbol_qualified_name <> '') as has_symbol, count(*) filter (artifact_digest <> '') as has_digest, count(*) filter (valid_to < 'infinity'::double) as is_closed from d""",
    "kill_rate": _E
    + f""", g as (select task_id, count(*) filter (is_stale) as n_invalid, count(*) filter (is_stale and not passed) as n_killed from e where task_id is not null group by 1)
select *, {_R('n_killed', 'n_invalid')} as kill_rate, coalesce(n_killed::double / nullif(n_invalid, 0), 0) >= 0.8 as strong from g""",
    "condition_pivot": _E
    + """, p as (select task_id, round(avg(passed::int) filter (method = 'full'), 6) as a, round(avg(passed::int) filter (method = 'bm25'), 6) as b, round(avg(passed::int) filter (method = 'no_validity'), 6) as c from e where task_id is not null group by 1)
select task_id, a as tsr_full, b as tsr_bm25, c as tsr_no_validity, round(a - b, 6) as lift, round(a - c, 6) as degradation, greatest(a, b, c) as best from p""",
    "distinct_counts": _E + " select count(distinct task_id) as n_tasks, count(distinct record_id) as n_records, count(distinct (family, method)) filter (family is not null and method is not null) as n_pairs from e",
    "extraction_quality": f"""with t as (select task_id as task_scope, min(description) as d from task_environments group by 1),
r as (select * from memory_records qualify row_number() over (partition by id order by ingest_seq) = 1),
j as (select r.task_scope, coalesce(artifact_hash, '') <> '' as attributed, len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(statement, '')), '[\\s\\x0B]+')), list_distinct(regexp_split_to_array(lower(coalesce(d, '')), '[\\s\\x0B]+')))) >= 2 as hit
  from r join t on t.task_scope = r.task_scope)
select task_scope, count(*) as n_extracted, count(*) filter (hit) as n_hits, {_R('count(*) filter (hit)', 'count(*)')} as precision, least(1.0, count(*) filter (hit))::double as recall, {_R('count(*) filter (attributed)', 'count(*)')} as attribution from j group by 1""",
    "gate_reduction": _E
    + " select task_id, bool_and(coalesce(passed, false)) as all_passed, bool_or(coalesce(passed, false)) as any_passed, bool_or(coalesce(stale_used, false)) as any_stale, count(*) filter (passed) as n_passed from e where task_id is not null group by 1",
    "gate_verdicts": """with e as (select min(recorded_at) as a, min(deleted_at) as g from evidence group by evidence_id),
r as (select (a // 100)::bigint as subject, ['causal', 'semantic', 'leakage', 'controls'][(a % 4 + 1)::int] as gate, case when g is not null then 'STALE_AUDIT' when a % 5 = 0 then 'FAIL' when a % 5 = 1 then 'GENERATED' else 'PASS' end as status from e where a is not null),
p as (select subject, coalesce(max(status) filter (gate = 'causal'), 'NOT_EXECUTED') as causal, coalesce(max(status) filter (gate = 'semantic'), 'NOT_EXECUTED') as semantic,
  coalesce(max(status) filter (gate = 'leakage'), 'NOT_EXECUTED') as leakage, coalesce(max(status) filter (gate = 'controls'), 'NOT_EXECUTED') as controls from r group by 1)
select *, case when 'NOT_EXECUTED' in (causal, semantic, leakage, controls) then 'NOT_EXECUTED' when 'STALE_AUDIT' in (causal, semantic, leakage, controls) then 'STALE_AUDIT'
  when causal = 'PASS' and semantic = 'PASS' and leakage = 'PASS' and controls in ('PASS', 'GENERATED') then 'PASS' else 'FAIL' end as verdict from p""",
    "capped_sample": f"with {sql.DELIVERIES} select artifact_uri, memory_id, row_number() over (partition by artifact_uri order by ingest_seq) as place from d where artifact_uri is not null qualify place <= 3",
    "labelled_sample": f"""with {sql.DELIVERIES} select artifact_uri, memory_id, status, place from (
  select *, row_number() over (partition by artifact_uri, status order by ingest_seq) as place from d where artifact_uri is not null and status in ('ACTIVE', 'SUPERSEDED'))
where place <= case status when 'ACTIVE' then 3 else 2 end order by artifact_uri, ingest_seq limit 20""",
    "audit_counters": """select case when trim(coalesce(text, '')) = '' then 'EMPTY' when lang is null then 'NO_LANGUAGE' when captured_at is null then 'NOT_CAPTURED' when length(text) > 10000 then 'TOO_LONG' else 'ACCEPTED' end as reason,
  doc_kind, count(*) as n from documents group by all""",
}
