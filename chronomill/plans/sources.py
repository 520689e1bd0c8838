"""Queries through sinks and sources: what is written must come back as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import scratch, table
from chronomill.sources import readers, writers

_LOG = "ingest_seq bigint, id string, task_scope string, statement string, evidence_ids array<string>, created_at bigint, valid_to bigint, role_tags array<string>"


def json_log(spark: SparkSession, d: str) -> DataFrame:
    """The legacy journal appended to a JSON lines log in two parts, and read from it."""
    records, path = table(spark, d, "memory_records"), scratch(spark, "log")
    columns = [f.split()[0] for f in _LOG.split(", ")]
    for half in (0, 1):
        writers.append_log(records.where(F.pmod("ingest_seq", F.lit(2)) == half).select(*columns), path)
    back = readers.json_lines(spark, path, _LOG)
    return back.select("ingest_seq", "id", "task_scope", F.md5("statement").alias("statement_md5"), F.array_join("evidence_ids", ",", "-").alias("evidence"), "created_at", "valid_to", F.size("role_tags").alias("n_tags"))


def json_records(spark: SparkSession, d: str) -> DataFrame:
    """The v1 store written as JSON lines, where an infinite end is a text, and read as records."""
    path = scratch(spark, "records")
    writers.write_lines(table(spark, d, "memory_records_v1").select(*[f.name for f in readers.RECORD.fields]), path)
    back = readers.records_json(spark, path)
    return back.groupBy("memory_id").agg(F.count("*").alias("n_rows"), F.min("valid_from").alias("valid_from"), F.max(F.when(F.col("valid_to") < 1e12, F.col("valid_to"))).alias("last_end"), F.count_if(F.coalesce(F.col("valid_to") > 1e12, F.lit(False))).alias("n_endless"))


def partitioned_export(spark: SparkSession, d: str) -> DataFrame:
    """Agent events exported to a folder for each method, those without a record left out, and counted from there."""
    path = scratch(spark, "export")
    events = table(spark, d, "episode_events").where("method is not null").select("event_id", "method", "status", "record_id")
    writers.export_by(events, "method", F.col("record_id").isNotNull(), path)
    return spark.read.parquet(path).groupBy("method", "status").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """The early half of the journal with the late half laid over it, the latest write of each record."""
    w = table(spark, d, "memory_records").where("id is not null").select("id", "ingest_seq", "created_at", "status")
    early = F.pmod("ingest_seq", F.lit(2)) == 0
    return writers.upsert(w.where(early), w.where(~early), "id", "ingest_seq")


def layered_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the tasks in two layers, initial and after, the later one over the earlier."""
    t = table(spark, d, "task_environments").where("task_id is not null")
    layer = lambda c: t.select("task_id", F.explode(c).alias("path", "content")).groupBy("task_id", "path").agg(F.max(F.struct("content"))["content"].alias("content"))
    keyed = lambda df: df.select(F.concat_ws("#", "task_id", "path").alias("path"), "content")
    files = readers.layered([keyed(layer("initial_workspace")), keyed(layer("workspace_transition"))])
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def tree_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Number, size and digest of all files of the layered workspaces."""
    files = layered_files(spark, d).where("sha256 is not null").withColumn("size", F.length("path").cast("bigint"))
    return readers.manifest(files)


QUERIES = {
    "json_log": json_log,
    "json_records": json_records,
    "partitioned_export": partitioned_export,
    "upserted": upserted,
    "layered_files": layered_files,
    "tree_manifest": tree_manifest,
}

_LAYERED = """i as (select task_id, f.key as path, max(f.value) as content from (select task_id, unnest(map_entries(initial_workspace)) as f from task_environments where task_id is not null) group by all),
t as (select task_id, f.key as path, max(f.value) as content from (select task_id, unnest(map_entries(workspace_transition)) as f from task_environments where task_id is not null) group by all),
l as (select coalesce(i.task_id, t.task_id) || '#' || coalesce(i.path, t.path) as path, sha256(case when t.task_id is not null then t.content else i.content end) as sha256 from i full join t on i.task_id = t.task_id and i.path = t.path)"""

ORACLES = {
    "json_log": "select ingest_seq, id, task_scope, md5(statement) as statement_md5, array_to_string(list_transform(evidence_ids, lambda x: coalesce(x, '-')), ',') as evidence, created_at, valid_to, coalesce(len(role_tags), -1)::int as n_tags from memory_records",
    "json_records": "select memory_id, count(*) as n_rows, min(valid_from) as valid_from, max(valid_to) filter (valid_to < 1e12) as last_end, count(*) filter (valid_to > 1e12) as n_endless from memory_records_v1 group by 1",
    "partitioned_export": "select method, status, count(*) as n, sum(event_id)::bigint as id_sum from episode_events where method is not null and record_id is not null group by all",
    "upserted": "select id, ingest_seq, created_at, status from memory_records where id is not null qualify row_number() over (partition by id order by ingest_seq desc) = 1",
    "layered_files": f"with {_LAYERED} select path, sha256 from l",
    "tree_manifest": f"with {_LAYERED} select count(*) as n_files, sum(length(path))::bigint as n_bytes, sha256(string_agg(path || ':' || sha256, chr(10) order by path)) as tree_sha256 from l where sha256 is not null",
}
