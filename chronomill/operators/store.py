"""The record store as DataFrames: id synthesis, last write wins, supersession, propagation, artifact checks.

Every function takes and returns immutable DataFrames, so a state can be read by any number of queries.
Keys are compared trimmed and in lower case. Where arrival order decides, ``seq`` is the arrival column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomill.common import OPEN_END, cut, norm_key

ACTIVE, SUPERSEDED, INVALIDATED = "ACTIVE", "SUPERSEDED", "INVALIDATED_BY_ARTIFACT"


def synthetic_id(statement: Column, as_of: Column) -> Column:
    """Id of a record written without one: a prefix and eight digits of the md5 of statement and tick."""
    return F.concat(F.lit("mem_"), F.substring(F.md5(F.concat(F.coalesce(statement, F.lit("")), as_of.cast("string"))), 1, 8))


def written(df: DataFrame) -> DataFrame:
    """Defaults of a write: id from content, valid from the write's tick, open end, active, global scope."""
    return df.select(
        "ingest_seq",
        F.coalesce("id", synthetic_id(F.col("statement"), F.col("created_at"))).alias("id"),
        F.coalesce("task_scope", F.lit("global")).alias("task_scope"),
        F.coalesce("type", F.lit("fact")).alias("type"),
        F.coalesce("statement", F.lit("")).alias("statement"),
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        "created_at",
        F.coalesce("valid_from", "created_at").alias("valid_from"),
        F.coalesce("valid_to", F.lit(OPEN_END)).cast("bigint").alias("valid_to"),
        norm_key("supersedes").alias("supersedes"),
        F.coalesce(F.upper(F.trim("status")), F.lit(ACTIVE)).alias("status"),
        F.coalesce("role_tags", F.array().cast("array<string>")).alias("role_tags"),
        F.coalesce("artifact_hash", F.lit("")).alias("artifact_hash"),
    )


def replay(writes: DataFrame, closing: DataFrame | None = None) -> DataFrame:
    """State after all writes in arrival order: the last write of an id replaces it, and each write first
    closes the record it supersedes at its own tick, where that record ends later.

    Only writes that arrive after the last write of their target still show, and the earliest of their ticks
    decides, so no order has to be replayed row by row. ``closing`` restricts the writes that close others, for
    rows of an earlier state among ``writes`` whose own closing has been done.
    """
    rest = [c for c in writes.columns if c not in ("id", "ingest_seq")]
    last = writes.groupBy("id").agg(F.max("ingest_seq").alias("ingest_seq"), F.max_by(F.struct(*rest), "ingest_seq").alias("_r"))
    last = last.select("id", "ingest_seq", "_r.*")
    closing = (writes if closing is None else closing).where("supersedes is not null").select(
        F.col("supersedes").alias("id"), F.col("created_at").alias("_tick"), F.col("ingest_seq").alias("_seq")
    )
    target = last.select("id", F.col("ingest_seq").alias("_last"), F.col("valid_to").alias("_ends"))
    closed = (
        closing.join(target, "id").where("_seq > _last and _tick < _ends").groupBy("id").agg(F.min("_tick").alias("_closed"))
    )
    return (
        last.join(closed, "id", "left")
        .withColumn("status", F.when(F.col("_closed").isNotNull(), SUPERSEDED).otherwise(F.col("status")))
        .withColumn("valid_to", F.coalesce("_closed", "valid_to"))
        .drop("_closed")
    )


def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The state after a further batch of writes, all of which arrived after those of the state."""
    return replay(batch) if state is None else replay(state.unionByName(batch), closing=batch)


def deliveries(v1: DataFrame) -> DataFrame:
    """The first delivery of each record of the v1 store, with clean references and open ends as infinity."""
    rest = [c for c in v1.columns if c not in ("memory_id", "ingest_seq")]
    one = v1.where("memory_id <> ''").groupBy("memory_id").agg(F.min("ingest_seq").alias("ingest_seq"), F.min_by(F.struct(*rest), "ingest_seq").alias("_r"))
    keys = F.filter(F.array_distinct(F.transform("depends_on", norm_key)), lambda k: k.isNotNull())
    return (
        one.select("memory_id", "ingest_seq", "_r.*")
        .withColumn("supersedes", norm_key("supersedes"))
        .withColumn("depends_on", F.coalesce(keys, F.array().cast("array<string>")))
        .withColumn("valid_to", F.coalesce("valid_to", F.lit(float("inf"))))
        .withColumn("status", F.upper(F.trim("status")))
        .withColumn("role_tags", F.coalesce("role_tags", F.array().cast("array<string>")))
    )


def superseded(records: DataFrame) -> DataFrame:
    """Direct supersession: a record that arrived no later than one that supersedes it is closed, whatever its
    status was, at the earliest begin of those. A target that arrives later is left alone."""
    by = records.where("supersedes is not null").select(
        F.col("supersedes").alias("memory_id"), F.col("valid_from").alias("_from"), F.col("ingest_seq").alias("_seq")
    )
    hit = (
        by.join(records.select("memory_id", "ingest_seq"), "memory_id")
        .where("_seq >= ingest_seq")
        .groupBy("memory_id")
        .agg(F.min("_from").alias("_from"), F.count("*").alias("_n"))
    )
    return (
        records.join(hit, "memory_id", "left")
        .withColumn("status", F.when(F.col("_n").isNotNull(), SUPERSEDED).otherwise(F.col("status")))
        .withColumn("valid_to", F.least("valid_to", "_from"))
        .drop("_from", "_n")
    )


def propagated(records: DataFrame) -> DataFrame:
    """Supersession with transitive invalidation of dependants, exactly as arrival order has it.

    Event k is the record with sequence k that supersedes a record that is there. It closes its target and
    walks from it to dependants that have arrived and are still active, which it closes too; a walk stops at
    records an earlier event closed, and dependants that arrive later live on until their parent is superseded
    again. So the event that reaches a record first is the least k that reaches one of its parents (as target
    or by the walk) once the record is there and not closed before: a fixed point over the dependency edges
    that is iterated with joins; each round settles at least the events in their order.
    """
    base = records.select("memory_id", "ingest_seq", "status", "valid_from", "supersedes", "depends_on")
    base = cut(base.select("*", (F.col("status") == ACTIVE).alias("_alive")).drop("status"))
    events = (
        base.where("supersedes is not null")
        .select(F.col("supersedes").alias("parent"), F.col("ingest_seq").alias("k"), F.col("valid_from").alias("_from"))
        .join(base.select(F.col("memory_id").alias("parent"), F.col("ingest_seq").alias("_there")), "parent")
        .where("k >= _there")
        .drop("_there")
    )
    events = cut(events)
    edges = (
        base.where("_alive")
        .select("memory_id", "ingest_seq", F.explode("depends_on").alias("parent"))
        .join(base.select(F.col("memory_id").alias("parent")), "parent")
    )
    edges = cut(edges)
    direct = events.groupBy(F.col("parent").alias("memory_id")).agg(F.min("k").alias("_direct"), F.min("_from").alias("_direct_from"))
    walked, before = None, None
    while True:
        out = events.select("parent", "k")
        if walked is not None:
            out = out.unionByName(walked.select(F.col("memory_id").alias("parent"), "k"))
        reached = edges.join(out, "parent").where("k >= ingest_seq").groupBy("memory_id").agg(F.min("k").alias("k"))
        # A record that an earlier event closed directly is not active when the walk comes by.
        reached = reached.join(direct.select("memory_id", "_direct"), "memory_id", "left")
        walked = cut(reached.where("_direct is null or k < _direct").select("memory_id", "k"))
        now = walked.agg(F.count("*"), F.sum("k"), F.bit_xor(F.xxhash64("memory_id", "k"))).first()
        if now == before:
            break
        before = now
    begins = events.select("k", F.col("_from").alias("_walk_from"))
    closed = walked.join(begins, "k").select("memory_id", "_walk_from")
    joined = records.join(direct, "memory_id", "left").join(closed, "memory_id", "left")
    hit = F.col("_direct").isNotNull() | F.col("_w")
    return (
        joined.join(walked.select("memory_id", F.lit(True).alias("_w")), "memory_id", "left")
        .withColumn("_w", F.coalesce("_w", F.lit(False)))
        .withColumn("status", F.when(hit, SUPERSEDED).otherwise(F.col("status")))
        .withColumn("valid_to", F.least("valid_to", "_direct_from", "_walk_from"))
        .drop("_direct", "_direct_from", "_walk_from", "_w")
    )


def workspace(tasks: DataFrame) -> DataFrame:
    """(task_id, path, content): the initial files overlaid by the transition; a null content is a deleted file."""
    both = F.array(
        F.struct(F.lit(0).alias("layer"), F.map_entries("initial_workspace").alias("files")),
        F.struct(F.lit(1).alias("layer"), F.map_entries("workspace_transition").alias("files")),
    )
    files = tasks.select("task_id", F.explode(both).alias("s")).select("task_id", "s.layer", F.explode("s.files").alias("f"))
    return (
        files.select("task_id", "layer", F.col("f.key").alias("path"), F.col("f.value").alias("content"))
        .groupBy("task_id", "path")
        .agg(F.max_by(F.struct("content"), "layer").alias("_f"))
        .select("task_id", "path", F.col("_f.content").alias("content"))
    )


def artifact_valid(records: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``artifact_valid``: without digest or path true; a missing file or another digest false.

    ``files`` has (path, content), each path once.
    """
    digests = files.where("content is not null").select(F.col("path").alias("artifact_uri"), F.sha2("content", 256).alias("_digest"))
    bound = (F.col("artifact_digest") != "") & (F.col("artifact_uri") != "")
    return (
        records.join(digests, "artifact_uri", "left")
        .withColumn("artifact_valid", ~F.coalesce(bound, F.lit(False)) | F.coalesce(F.col("_digest") == F.col("artifact_digest"), F.lit(False)))
        .drop("_digest")
    )


def symbol_valid(records: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``symbol_valid``: the digest of the qualified name, else of its last part, else the file's digest.

    ``symbols`` has (path, qualified_name, symbol_digest), each name of a path once.
    """
    full = symbols.select(F.col("path").alias("artifact_uri"), F.col("qualified_name").alias("_q"), F.col("symbol_digest").alias("_full"))
    short = full.select("artifact_uri", F.col("_q").alias("_s"), F.col("_full").alias("_short"))
    there = files.where("content is not null").select(F.col("path").alias("artifact_uri"), F.lit(True).alias("_there"))
    r = artifact_valid(records, files).withColumn("_q", F.col("symbol_qualified_name")).withColumn("_s", F.element_at(F.split("symbol_qualified_name", r"\."), -1))
    r = r.join(there, "artifact_uri", "left").join(full, ["artifact_uri", "_q"], "left").join(short, ["artifact_uri", "_s"], "left")
    set_ = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    verdict = (
        F.when(~set_("artifact_uri") | ~set_("artifact_digest") & ~set_("symbol_digest"), True)
        .when(F.col("_there").isNull(), False)
        .when(~set_("symbol_qualified_name") | ~set_("symbol_digest"), F.col("artifact_valid"))
        .otherwise(F.coalesce(F.coalesce("_full", "_short") == F.col("symbol_digest"), F.lit(False)))
    )
    return r.withColumn("symbol_valid", verdict).drop("_q", "_s", "_full", "_short", "_there", "artifact_valid")
