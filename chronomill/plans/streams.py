"""Streaming queries, each run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import table
from chronomill.operators import references
from chronomill.plans import store as store_plans
from chronomill.plans import ledgers
from chronomill.streaming import journal


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return journal.log_stream(spark, f"{d}/{name}.parquet", table(spark, d, name).schema, "parquet")


def stream_store(spark: SparkSession, d: str) -> DataFrame:
    """State of the legacy store, folded batch by batch from the stream of its writes."""
    state = journal.store_state(spark).run(_stream(spark, d, "memory_records"))
    return state["records"].select("id", "ingest_seq", "created_at", "valid_from", "valid_to", "status")


def stream_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Superseded records that were not there, from the stream of writes."""
    refs = lambda b: references.scalar_refs(b, "supersedes", "record", "supersedes", "ingest_seq", "created_at")
    parents = lambda b: references.parent_rows(b, "record", "id", "created_at")
    state = journal.orphan_state(spark, refs, parents).run(_stream(spark, d, "memory_records"))
    return journal.orphans_of(state).orphans().select("ref_field", "ingest_seq", "ref_key")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts and sums per kind of event."""
    # Times without a zone are read as UTC, whatever zone the session has.
    utc = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    counts = journal.drained(journal.windowed(_stream(spark, d, "events").withColumn("ts", utc), "ts", ["event_type"], "value"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window_start") / 86_400).cast("int"))
    return counts.withColumn("window_start", day.cast("string"))


QUERIES = {"stream_store": stream_store, "stream_orphans": stream_orphans, "stream_windows": stream_windows}

ORACLES = {
    "stream_store": store_plans.ORACLES["store_replay"],
    "stream_orphans": ledgers.ORPHANS_SQL + " select ref_field, ingest_seq, ref_key from watched where ref_field = 'supersedes' and (first_at is null or first_at > tk)",
    "stream_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by all",
}
