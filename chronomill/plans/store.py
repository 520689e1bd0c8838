"""Queries on the record store: ids, writes, supersession, propagation, artifact and symbol validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import table
from chronomill.functions import code
from chronomill.operators import store
from chronomill.plans import sql


def legacy_state(spark: SparkSession, d: str) -> DataFrame:
    return store.replay(store.written(table(spark, d, "memory_records")))


def v1_records(spark: SparkSession, d: str) -> DataFrame:
    return store.deliveries(table(spark, d, "memory_records_v1"))


def write_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_records").select(
        "ingest_seq", store.synthetic_id(F.col("statement"), F.col("created_at")).alias("new_id")
    )


def write_defaults(spark: SparkSession, d: str) -> DataFrame:
    w = store.written(table(spark, d, "memory_records"))
    return w.select("ingest_seq", "id", "task_scope", "valid_from", "valid_to", "supersedes", "status", F.array_join("role_tags", ",").alias("role_tags"))


def store_replay(spark: SparkSession, d: str) -> DataFrame:
    return legacy_state(spark, d).select("id", "ingest_seq", "created_at", "valid_from", "valid_to", "status")


def store_supersede(spark: SparkSession, d: str) -> DataFrame:
    return store.superseded(v1_records(spark, d)).select("memory_id", "status", "valid_to")


def store_propagate(spark: SparkSession, d: str) -> DataFrame:
    return store.propagated(v1_records(spark, d)).select("memory_id", "status", "valid_to")


def overlay_workspace(spark: SparkSession, d: str) -> DataFrame:
    files = store.workspace(table(spark, d, "task_environments"))
    return files.select("task_id", "path", F.sha2("content", 256).alias("digest"), F.length("content").alias("n_chars"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One content per path: that of the least task that has the path now."""
    w = store.workspace(table(spark, d, "task_environments")).where("content is not null")
    return w.groupBy("path").agg(F.min(F.struct("task_id", "content")).alias("_f")).select("path", F.col("_f.content").alias("content"))


def artifact_validity(spark: SparkSession, d: str) -> DataFrame:
    """Files of the workspace against the digests that records of the same path hold."""
    v1 = v1_records(spark, d)
    checked = store.artifact_valid(v1, _files(spark, d))
    return checked.select(
        "memory_id",
        "artifact_valid",
        F.when((F.col("status") == store.ACTIVE) & ~F.col("artifact_valid"), store.INVALIDATED).otherwise(F.col("status")).alias("status"),
    )


def symbol_validity(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    symbols = code.symbol_digests(files, "path", "content")
    checked = store.symbol_valid(v1_records(spark, d), files, symbols)
    return checked.select("memory_id", "symbol_valid")


QUERIES = {
    "write_ids": write_ids,
    "write_defaults": write_defaults,
    "store_replay": store_replay,
    "store_supersede": store_supersede,
    "store_propagate": store_propagate,
    "overlay_workspace": overlay_workspace,
    "artifact_validity": artifact_validity,
    "symbol_validity": symbol_validity,
}

_WORKSPACE = """
m as (
  select task_id, 0 as layer, unnest(map_entries(initial_workspace)) as f from task_environments
  union all select task_id, 1, unnest(map_entries(workspace_transition)) from task_environments
), ws as (
  select task_id, f.key as path, f.value as content from m qualify row_number() over (partition by task_id, f.key order by layer desc) = 1
), files as (select path, arg_min(content, task_id) as content from ws where content is not null group by 1)"""

ORACLES = {
    "write_ids": "select ingest_seq, 'mem_' || left(md5(coalesce(statement, '') || created_at::varchar), 8) as new_id from memory_records",
    "write_defaults": "with" + sql.REPLAY + " select ingest_seq, id, task_scope, valid_from, valid_to, supersedes, status, array_to_string(role_tags, ',') as role_tags from w",
    "store_replay": "with" + sql.REPLAY + " select id, ingest_seq, created_at, valid_from, valid_to, status from store",
    "store_supersede": "with"
    + sql.DELIVERIES
    + """, hit as (select p.memory_id, min(c.valid_from) as tick from d c join d p on c.supersedes = p.memory_id where c.ingest_seq >= p.ingest_seq group by 1)
select d.memory_id, case when h.memory_id is not null then 'SUPERSEDED' else status end as status, least(valid_to, h.tick) as valid_to
from d left join hit h on h.memory_id = d.memory_id""",
    "overlay_workspace": "with" + _WORKSPACE + " select task_id, path, sha256(content) as digest, length(content) as n_chars from ws",
    "artifact_validity": "with"
    + sql.DELIVERIES
    + ","
    + _WORKSPACE
    + """, v as (
  select memory_id, status, case when coalesce(artifact_digest, '') = '' or coalesce(artifact_uri, '') = '' then true else coalesce(sha256(content) = artifact_digest, false) end as artifact_valid
  from d left join files on path = artifact_uri
) select memory_id, artifact_valid, case when status = 'ACTIVE' and not artifact_valid then 'INVALIDATED_BY_ARTIFACT' else status end as status from v""",
}
