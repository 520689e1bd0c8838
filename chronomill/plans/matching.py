"""Join queries: defaults, semi and anti, differences of trees and fields, overlays, pairs, code comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import norm_key, table
from chronomill.functions import code
from chronomill.functions import text as tx
from chronomill.operators import matching, rules
from chronomill.plans import sql
from chronomill.plans.evaluation import events
from chronomill.plans.store import v1_records


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks, each once."""
    t = table(spark, d, "task_environments")
    rest = [c for c in t.columns if c != "task_id" and not c.endswith(("workspace", "transition"))]
    return t.where("task_id is not null").groupBy("task_id").agg(F.max(F.struct(*rest)).alias("_t")).select("task_id", "_t.*")


def join_inner(spark: SparkSession, d: str) -> DataFrame:
    j = events(spark, d).join(tasks(spark, d).select("task_id", "task_family"), "task_id")
    return j.groupBy("task_family", "method").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


def join_default(spark: SparkSession, d: str) -> DataFrame:
    """Events with their record's status; UNKNOWN where no record is there."""
    r = table(spark, d, "memory_records").groupBy("id").agg(F.max_by(F.upper(F.trim("status")), "ingest_seq").alias("_s"))
    e = events(spark, d).select("event_id", norm_key("record_id").alias("id"))
    return e.join(r, "id", "left").groupBy(F.coalesce("_s", F.lit("UNKNOWN")).alias("record_status")).agg(F.count("*").alias("n"))


def join_adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """First and last label of a record, a human label from the v1 store's roles, and what is settled from them."""
    r = table(spark, d, "memory_records").where("status is not null")
    label = F.upper(F.trim("status"))
    a = r.groupBy("id").agg(F.min_by(label, "ingest_seq").alias("a"))
    b = r.groupBy("id").agg(F.max_by(label, "ingest_seq").alias("b"))
    human = r.where("array_contains(role_tags, 'reviewer')").groupBy("id").agg(F.max(label).alias("h"))
    final, how = rules.adjudicated(F.col("a"), F.col("b"), F.col("h"), F.lit("DISPUTED"))
    return a.join(b, "id").join(human, "id", "left").select("id", final.alias("label"), how.alias("settled_by"))


def join_semi(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that any event ran."""
    return tasks(spark, d).join(events(spark, d), "task_id", "left_semi").select("task_id", "category")


def join_anti(spark: SparkSession, d: str) -> DataFrame:
    """Records that no event used."""
    ids = table(spark, d, "memory_records").select("id").distinct()
    return ids.join(events(spark, d).select(norm_key("record_id").alias("id")), "id", "left_anti")


def _tree(spark: SparkSession, d: str, side: str) -> DataFrame:
    t = table(spark, d, "task_environments").where("workspace_transition is not null and task_id is not null")
    files = t.select("task_id", F.explode(side).alias("path", "content")).where("content is not null")
    return files.groupBy("task_id", "path").agg(F.min("content").alias("content"))


def tree_difference(spark: SparkSession, d: str) -> DataFrame:
    """Files that differ between a task's initial workspace and its transition."""
    a, b = (_tree(spark, d, s).select("task_id", "path", F.sha2("content", 256).alias("digest")) for s in ("initial_workspace", "workspace_transition"))
    return matching.tree_difference(a, b, ["task_id", "path"], "digest")


def join_dependants(spark: SparkSession, d: str) -> DataFrame:
    """Each record with how many records depend on it directly."""
    v = v1_records(spark, d)
    edges = v.select(F.explode("depends_on").alias("parent"), F.col("memory_id").alias("child"))
    n = edges.groupBy(F.col("parent").alias("memory_id")).agg(F.count("*").alias("n_dependants"))
    return v.select("memory_id").join(n, "memory_id")


def join_substring(spark: SparkSession, d: str) -> DataFrame:
    """Files of a task's workspace that mention its target symbol."""
    t = tasks(spark, d).select("task_id", "target_symbol")
    return _tree(spark, d, "initial_workspace").join(t, "task_id").where(F.contains("content", F.col("target_symbol"))).select("task_id", "path")


def field_differences(spark: SparkSession, d: str) -> DataFrame:
    """Fields in which the first and the last write of a record differ."""
    r = table(spark, d, "memory_records")
    fields = ["task_scope", "valid_from", "valid_to", "supersedes", "status", "artifact_hash"]
    pick = lambda f: r.groupBy("id").agg(f(F.struct(*fields), "ingest_seq").alias("_r")).select("id", "_r.*")
    return matching.field_differences(pick(F.min_by), pick(F.max_by), "id", fields)


def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    """Records judged by evidence stamped with a fingerprint: of their statement now, or of another one."""
    v = v1_records(spark, d).select("memory_id", "statement", "ingest_seq")
    stamped = v.where(F.pmod("ingest_seq", F.lit(3)) > 0).select(
        "memory_id",
        tx.fingerprint(F.col("memory_id"), F.when(F.pmod("ingest_seq", F.lit(3)) == 1, F.col("statement")).otherwise(F.lit("old"))).alias("fingerprint"),
        F.when(F.pmod("ingest_seq", F.lit(2)) == 0, "PASS").otherwise("FAIL").alias("status"),
    )
    return matching.evidence_status(v, stamped, "memory_id", tx.fingerprint(F.col("memory_id"), F.col("statement"))).select("memory_id", "evidence_status")


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each statement."""
    r = table(spark, d, "memory_records").where("statement is not null")
    return r.groupBy("statement").agg(F.min_by("id", "ingest_seq").alias("id"), F.min("ingest_seq").alias("ingest_seq")).select("id", "ingest_seq")


def overlay_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of even sequence overlaid by those of odd sequence, value by value."""
    r = table(spark, d, "memory_records")
    cols = ["task_scope", "valid_to", "status"]
    side = lambda k: r.where(F.pmod("ingest_seq", F.lit(2)) == k).groupBy("id").agg(F.max_by(F.struct(*cols), "ingest_seq").alias("_r")).select("id", "_r.*")
    return matching.overlay(side(0), side(1), "id")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of union, intersection and differences of the ids that records and events name."""
    a = table(spark, d, "memory_records").select("id")
    b = events(spark, d).select(norm_key("record_id").alias("id")).where("id is not null")
    size = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
    return size("union", a.union(b).distinct()).union(size("intersect", a.intersect(b))).union(size("except", a.subtract(b))).union(size("only_events", b.subtract(a)))


def api_changes(spark: SparkSession, d: str) -> DataFrame:
    """Functions and classes that a transition removes, adds, changes or deprecates, per task and file; a missing file is empty."""
    named = table(spark, d, "task_environments").where("workspace_transition is not null and task_id is not null")
    paths = named.select("task_id", F.explode(F.map_keys("workspace_transition")).alias("path")).where("endswith(path, '.py')").distinct()
    side = lambda s, name: _tree(spark, d, s).withColumnRenamed("content", name)
    both = paths.join(side("initial_workspace", "before"), ["task_id", "path"], "left").join(side("workspace_transition", "after"), ["task_id", "path"], "left")
    keyed = both.select(F.concat_ws("#", "task_id", "path").alias("file_key"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    return code.api_changes(code.symbol_definitions(keyed, "file_key", "before"), code.symbol_definitions(keyed, "file_key", "after"), "file_key")


def symbol_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Whether a task's target symbol is defined once, several times or not at all in its workspace."""
    files = _tree(spark, d, "initial_workspace").where("endswith(path, '.py')")
    return code.resolved(tasks(spark, d).select("task_id", F.col("target_symbol").alias("symbol")), code.symbol_definitions(files, "task_id", "content"), "task_id")


def deprecated_use(spark: SparkSession, d: str) -> DataFrame:
    """Hidden tests and sources that act on a task's stale names, or only mention them."""
    t = tasks(spark, d).select("task_id", "stale_patterns", "required_patterns")
    s = _tree(spark, d, "initial_workspace").where("endswith(path, '.py')").join(t, "task_id")
    s = s.withColumn("file_key", F.concat_ws("#", "task_id", "path")).withColumn("names", F.array_union("stale_patterns", F.array(F.lit("re.compile"), F.lit("json"), F.lit("os.path"))))
    return code.deprecated_use(s, "file_key", "content", "names")


def stale_names(spark: SparkSession, d: str) -> DataFrame:
    """Sources that act on a task's stale names in any way, or only mention them."""
    t = tasks(spark, d).select("task_id", "stale_patterns")
    s = _tree(spark, d, "initial_workspace").where("endswith(path, '.py')").join(t, "task_id").withColumn("file_key", F.concat_ws("#", "task_id", "path"))
    return code.stale_names(s, "file_key", "content", "stale_patterns")


def solution_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether the transition already holds a whole function body of the initial workspace, per file."""
    both = _tree(spark, d, "initial_workspace").alias("a").join(_tree(spark, d, "workspace_transition").alias("b"), ["task_id", "path"]).where("endswith(path, '.py')")
    keyed = both.select(F.concat_ws("#", "task_id", "path").alias("file_key"), F.col("a.content").alias("solution"), F.col("b.content").alias("context"))
    return code.solution_overlap(keyed.select("file_key", "context"), keyed.select("file_key", "solution"), "file_key")


def symbol_table_digests(spark: SparkSession, d: str) -> DataFrame:
    """Symbols present on both sides of a transition, and whether their digest stayed."""
    side = lambda s: code.symbol_digests(_tree(spark, d, s).where("endswith(path, '.py')").withColumn("file_key", F.concat_ws("#", "task_id", "path")), "file_key", "content")
    a, b = side("initial_workspace"), side("workspace_transition").select("file_key", "qualified_name", F.col("symbol_digest").alias("_b"))
    return a.join(b, ["file_key", "qualified_name"]).groupBy("symbol_type").agg(F.count("*").alias("n"), F.count_if(F.col("symbol_digest") == F.col("_b")).alias("n_same"))


QUERIES = {
    k: globals()[k]
    for k in (
        "join_inner", "join_default", "join_adjudicated", "join_semi", "join_anti", "tree_difference", "join_dependants", "join_substring", "field_differences",
        "evidence_status", "first_seen", "overlay_records", "set_operations", "api_changes", "symbol_resolution", "deprecated_use", "stale_names", "solution_overlap", "symbol_table_digests",
    )
}

_T = "t as (select distinct on (task_id) * from (select distinct task_id, task_family, category, target_symbol from task_environments where task_id is not null))"
_E = "e as (select *, status = 'PASSED' as passed from (select distinct * from episode_events))"
_SIDE = """a as (select task_id, f.key as path, min(f.value) as c from (select task_id, unnest(map_entries(initial_workspace)) as f from task_environments where workspace_transition is not null and task_id is not null) where f.value is not null group by all),
b as (select task_id, f.key as path, min(f.value) as c from (select task_id, unnest(map_entries(workspace_transition)) as f from task_environments where task_id is not null) where f.value is not null group by all)"""

ORACLES = {
    "join_inner": f"with {_T}, {_E} select task_family, method, count(*) as n, count(*) filter (passed) as n_passed from e join t using (task_id) group by all",
    "join_default": f"with {_E}, r as (select id, arg_max(upper(trim(status)), ingest_seq) as s from memory_records group by 1) select coalesce(s, 'UNKNOWN') as record_status, count(*) as n from e left join r on {sql.key('record_id')} = r.id group by 1",
    "join_adjudicated": """with l as (select id, arg_min(upper(trim(status)), ingest_seq) as a, arg_max(upper(trim(status)), ingest_seq) as b,
  max(upper(trim(status))) filter (list_contains(role_tags, 'reviewer')) as h from memory_records where status is not null group by 1)
select id, case when a = b then a else coalesce(h, 'DISPUTED') end as label, case when a = b then 'CONSENSUS' when h is not null then 'HUMAN_ADJUDICATED' else 'EVIDENCE_ADJUDICATED' end as settled_by from l""",
    "join_semi": f"with {_T}, {_E} select task_id, category from t where task_id in (select task_id from e)",
    "join_anti": f"with {_E} select distinct id from memory_records where id not in (select {sql.key('record_id')} as k from e where k is not null)",
    "tree_difference": f"with {_SIDE} select coalesce(a.task_id, b.task_id) as task_id, coalesce(a.path, b.path) as path, case when b.path is null then 'MISSING' when a.path is null then 'EXTRA' else 'SHA_MISMATCH' end as difference from a full join b on a.task_id = b.task_id and a.path = b.path where a.c is distinct from b.c",
    "join_dependants": f"with {sql.DELIVERIES}, x as (select distinct memory_id as child, {sql.key('u')} as parent from (select memory_id, unnest(depends_on) as u from memory_records_v1 qualify dense_rank() over (partition by memory_id order by ingest_seq) = 1)) select parent as memory_id, count(*) as n_dependants from x where parent in (select memory_id from d) group by 1",
    "join_substring": f"with {_T}, {_SIDE} select a.task_id, path from a join t on a.task_id = t.task_id where contains(c, target_symbol)",
    "field_differences": """with f as (select * from memory_records qualify row_number() over (partition by id order by ingest_seq) = 1), l as (select * from memory_records qualify row_number() over (partition by id order by ingest_seq desc) = 1),
x as (select f.id, unnest([{'field': 'task_scope', 'l': f.task_scope, 'r': l.task_scope}, {'field': 'valid_from', 'l': f.valid_from::varchar, 'r': l.valid_from::varchar}, {'field': 'valid_to', 'l': f.valid_to::varchar, 'r': l.valid_to::varchar},
  {'field': 'supersedes', 'l': f.supersedes, 'r': l.supersedes}, {'field': 'status', 'l': f.status, 'r': l.status}, {'field': 'artifact_hash', 'l': f.artifact_hash, 'r': l.artifact_hash}]) as d from f join l on f.id = l.id)
select id, d.field as field, d.l as left_value, d.r as right_value from x where d.l is distinct from d.r""",
    "evidence_status": f"with {sql.DELIVERIES} select memory_id, case when ingest_seq % 3 = 0 then 'NOT_EXECUTED' when ingest_seq % 3 = 2 and coalesce(statement, 'MISSING') <> 'old' then 'STALE_AUDIT' when ingest_seq % 2 = 0 then 'PASS' else 'FAIL' end as evidence_status from d",
    "first_seen": "select arg_min(id, ingest_seq) as id, min(ingest_seq) as ingest_seq from memory_records where statement is not null group by statement",
    "overlay_records": """with r as (select *, ingest_seq % 2 as k from memory_records qualify row_number() over (partition by id, ingest_seq % 2 order by ingest_seq desc) = 1)
select coalesce(a.id, b.id) as id, coalesce(b.task_scope, a.task_scope) as task_scope, coalesce(b.valid_to, a.valid_to) as valid_to, coalesce(b.status, a.status) as status
from (select * from r where k = 0) a full join (select * from r where k = 1) b on a.id = b.id""",
    "set_operations": f"""with {_E}, a as (select distinct id from memory_records), b as (select distinct {sql.key('record_id')} as id from e where {sql.key('record_id')} is not null),
m as (select count(*) - count(distinct id) as extra, count(distinct id) as n from memory_records)
select 'union' as operation, (select count(*) from (select id from a union select id from b)) as n union all select 'intersect', (select count(*) from a where id in (select id from b))
union all select 'except', (select count(*) from a where id not in (select id from b)) union all select 'only_events', (select count(*) from b where id not in (select id from a))""",
}
