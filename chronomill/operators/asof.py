"""Attributes as known at event time: for each event the latest write of its entity that stood by then.

Events and writes are co-grouped by entity and time: both go through one range partitioning on (entity, tick) and so
meet in the same sorted run, where a vectorised binary search over (entity, tick, sequence) finds each event's
write. Runs are cut by rows, so an entity with any part of all rows spreads over as many as it needs. Only the events
before the first write of the run that an entity goes on in are open; they take the last write of that entity
in the nearest run before, of which there is one for each run.

Defined cases: an event without entity or time has no answer; entities are compared trimmed and in lower
case; of writes at one tick the greatest sequence counts (a null one counts least); writes without a
recorded time never stand; events delivered twice come out once, events without a key as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomill.common import cut, norm_key
from chronomill.operators.runs import in_runs

WRITE, EVENT = 0, 1
DONE, OPEN, LAST = "done", "open", "last"


def latest_by(
    ent_w: np.ndarray, at_w: np.ndarray, seq_w: np.ndarray, ent_e: np.ndarray, at_e: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Index of the write that stands at each event, and whether there is one."""
    order = np.lexsort((seq_w, at_w, ent_w))
    ticks = np.unique(np.concatenate([at_w, at_e]))
    span = len(ticks) + 1
    have = ent_w[order] * span + np.searchsorted(ticks, at_w[order])
    want = ent_e * span + np.searchsorted(ticks, at_e)
    pos = np.searchsorted(have, want, side="right") - 1
    found = pos >= 0
    pos = pos.clip(0)
    if len(order):
        found &= ent_w[order[pos]] == ent_e
        return order[pos], found
    return pos, np.zeros(len(ent_e), bool)


def _solve(run: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: _entity, _at, _kind, _seq, _key, _event, _write, in this order of rows."""

    def row(kind: str, entity: pa.Array, event: pa.Array, at: pa.Array, seq: pa.Array, write: pa.Array) -> pa.RecordBatch:
        n = len(entity)
        cols = [pa.array(np.full(n, run, np.int64)), pa.array([kind] * n, pa.string()), entity, event, at, seq, write]
        return pa.RecordBatch.from_arrays(cols, ["_run", "_what", "_entity", "_event", "_write_at", "_write_seq", "_write"])

    stands: pa.RecordBatch | None = None  # the last write so far
    before: tuple | None = None  # entity, tick and key of the last event so far
    first: str | None = None
    for b in batches:
        if not b.num_rows:
            continue
        first = b.column("_entity")[0].as_py() if first is None else first
        t = b if stands is None else pa.Table.from_batches([stands, b]).combine_chunks().to_batches()[0]
        kind, at = t.column("_kind").to_numpy(), t.column("_at").to_numpy()
        code = t.column("_entity").dictionary_encode().indices.to_numpy().astype(np.int64)
        w, e = np.flatnonzero(kind == WRITE), np.flatnonzero(kind == EVENT)
        # Deliveries of one event stand next to each other.
        key = t.column("_key").take(pa.array(e))
        named = key.is_valid().to_numpy(zero_copy_only=False)
        no = key.dictionary_encode().indices.fill_null(-1).to_numpy()
        again = np.append(False, (no[1:] == no[:-1]) & (code[e][1:] == code[e][:-1]) & (at[e][1:] == at[e][:-1])) & named if len(e) else np.zeros(0, bool)
        if len(e):
            this = (t.column("_entity")[int(e[0])].as_py(), int(at[e[0]]), key[0].as_py())
            again[0] = this == before and named[0]
            before = (t.column("_entity")[int(e[-1])].as_py(), int(at[e[-1]]), key[-1].as_py())
        e = e[~again]
        pos, found = latest_by(code[w], at[w], t.column("_seq").to_numpy()[w], code[e], at[e])
        hit = w[pos[found]] if len(w) else pos[found]
        if found.any():
            pick = lambda c, i: t.column(c).take(pa.array(i))
            yield row(DONE, pick("_entity", e[found]), pick("_event", e[found]), pick("_at", hit), pick("_seq", hit), pick("_write", hit))
        left = pa.array(e[~found])
        entity = t.column("_entity").take(left)
        head = np.array([x == first for x in entity.to_pylist()], bool)
        if head.any():
            mine, none = pa.array(np.flatnonzero(head)), pa.nulls(int(head.sum()), pa.int64())
            yield row(OPEN, entity.take(mine), t.column("_event").take(left).take(mine), none, none, pa.nulls(len(none), t.column("_write").type))
        if len(w):
            stands = t.slice(int(w[-1]), 1)
    if stands is not None:
        yield row(LAST, stands.column("_entity"), pa.nulls(1, stands.column("_event").type), stands.column("_at"), stands.column("_seq"), stands.column("_write"))


def as_known(
    events: DataFrame,
    writes: DataFrame,
    event_key: str,
    event_entity: str,
    event_at: str,
    event_columns: dict[str, str],
    write_entity: str,
    write_at: str,
    write_seq: str,
    attributes: dict[str, str],
    runs: int | None = None,
) -> DataFrame:
    """(event_key, *event_columns, *attributes, _write_at, _write_seq): each event with the write that stood.

    ``event_columns`` and ``attributes`` map output names to columns, so names that clash in the two tables
    stay apart. Events without a standing write give no row.
    """
    told = F.struct(F.col(event_key).alias(event_key), *[F.col(c).alias(k) for k, c in event_columns.items()])
    held = F.struct(*[F.col(c).alias(k) for k, c in attributes.items()])
    event_type, write_type = (df.select(c.alias("x")).schema["x"].dataType.simpleString() for df, c in ((events, told), (writes, held)))
    e = events.select(
        norm_key(event_entity).alias("_entity"),
        F.col(event_at).cast("bigint").alias("_at"),
        F.lit(EVENT).alias("_kind"),
        F.lit(0).cast("bigint").alias("_seq"),
        F.col(event_key).cast("string").alias("_key"),
        told.alias("_event"),
        F.lit(None).cast(write_type).alias("_write"),
    )
    w = writes.select(
        norm_key(write_entity).alias("_entity"),
        F.col(write_at).cast("bigint").alias("_at"),
        F.lit(WRITE).alias("_kind"),
        F.coalesce(F.col(write_seq).cast("bigint"), F.lit(-(2**62))).alias("_seq"),
        F.lit(None).cast("string").alias("_key"),
        F.lit(None).cast(event_type).alias("_event"),
        held.alias("_write"),
    )
    both = e.unionByName(w).where("_entity is not null and _at is not null")
    schema = f"_run bigint, _what string, _entity string, _event {event_type}, _write_at bigint, _write_seq bigint, _write {write_type}"
    solved = cut(in_runs(both, ["_entity", "_at", "_kind", "_seq", "_key"], _solve, schema, runs))
    # One row for each run: what stood at its end. Open events look back to the nearest run with a write of theirs.
    what = ["_write_at", "_write_seq", "_write"]
    marks = solved.where(F.col("_what") == LAST).select("_entity", "_run", F.struct(*what).alias("_w"))
    asked = solved.where(F.col("_what") == OPEN).select("_entity", "_run").distinct()
    back = Window.partitionBy("_entity").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    stood = asked.withColumn("_asked", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    # A run that asks may itself end with a later write of the entity.
    by_run = stood.groupBy("_entity", "_run").agg(F.max("_asked").alias("_asked"), F.first("_w", ignorenulls=True).alias("_w"))
    carried = by_run.withColumn("_before", F.last("_w", ignorenulls=True).over(back)).where("_asked and _before is not null")
    opened = solved.where(F.col("_what") == OPEN).drop(*what).join(carried.select("_entity", "_run", "_before.*"), ["_entity", "_run"])
    all_ = solved.where(F.col("_what") == DONE).select("_event", *what).unionByName(opened.select("_event", *what))
    return all_.select("_event.*", "_write_at", "_write_seq", "_write.*")
