"""History of changing attributes: a bitemporal ledger of an entity's writes, and the versions that stand in it.

Every ledger row is one write's state over a period of ticks (``version_from`` to ``version_to``) as it was known over
a period of arrivals (``recorded_from`` to ``recorded_to``, in the sequence of arrival). A write that arrives in
order ends the period of the one before. One that arrives late splits the period its tick falls into. In both cases
the row it cuts short is closed and told anew with the shorter period; a correction in the same tick closes the row
it corrects. Rows are closed, never changed or removed, so any earlier state of knowledge can be read.

A sweep line over the ticks of each entity finds the two neighbours each write had when it arrived: the nearest on
either side that arrived before it. A write and its neighbour before it give all ledger rows there are, at most two
for each write. The versions are the ledger's rows that are still open, joined where the state does not change.

Scale: sweeps run over sorted runs, so an entity with any part of all rows spreads over many. Writes whose
neighbours lie beyond their run's border are settled anew: an entity of at most ``RUN_ROWS`` writes as a whole, a larger one by joins on
what can be seen from outside a run, the writes that no write beyond them in the run precedes in arrival.

Defined cases: rows without entity or tick are left out; null attributes are values (null equals null); of several
writes at one tick the greatest sequence counts, a null one least; rows equal in all of this stand in any order;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomill.common import OPEN_END, cut
from chronomill.operators.runs import in_runs

NO_SEQUENCE = -(2**62)
RUN_ROWS = 500_000
"""Entities with at most so many writes are swept in one piece."""


def neighbours(seq: list[int], begins: set[int]) -> tuple[list[int], list[int]]:
    """For each write, in the order of ticks, the nearest before and behind it that arrived earlier (-1: none).

    ``begins`` holds the places where an entity begins. Of equal sequences the first in order arrived earlier.
    """
    before, behind = [-1] * len(seq), [-1] * len(seq)
    waiting: list[int] = []
    for i, s in enumerate(seq):
        if i in begins:
            waiting.clear()
        while waiting and seq[waiting[-1]] > s:
            behind[waiting.pop()] = i
        if waiting:
            before[i] = waiting[-1]
        waiting.append(i)
    return before, behind


def _sweep(run: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes with their neighbours inside the run. Columns: _id, _at, _seq, _tie, _state."""
    held: list[pa.RecordBatch] = []
    state = {"done": 0, "first": None}

    def swept(rows: list[pa.RecordBatch], end: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        code = t["_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        new = np.append(True, code[1:] != code[:-1])
        seq = t["_seq"].to_numpy()
        before, behind = (np.array(x) for x in neighbours(seq.tolist(), set(np.flatnonzero(new).tolist())))
        ids = t["_id"]
        if state["first"] is None:
            state["first"] = ids[0].as_py()
        # An entity of the run's border may have neighbours beyond it.
        head = (code == code[0]) if ids[0].as_py() == state["first"] else np.zeros(len(code), bool)
        tail = (code == code[-1]) if end else np.zeros(len(code), bool)
        no = np.arange(len(code)) + state["done"]
        state["done"] += len(code)
        at = t["_at"].to_numpy()
        some = lambda x, v, m: pa.array(np.where(m, v[x.clip(0)], 0), mask=~m)
        cols = [
            pa.array(np.full(len(code), run, np.int64)), pa.array(no.astype(np.int64)), ids.combine_chunks(), pa.array(at), pa.array(seq), t["_state"].combine_chunks(),
            some(before, no, before >= 0), some(before, at, before >= 0), t["_state"].combine_chunks().take(pa.array(before, mask=before < 0)), some(behind, at, behind >= 0),
            pa.array(head & (before < 0)), pa.array(tail & (behind < 0)), pa.array(head | tail),
        ]
        return pa.RecordBatch.from_arrays(cols, _SWEPT)

    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).dictionary_encode().indices.to_numpy()
        last = int(np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[-1])
        goes_on = held and held[-1].column(0)[-1].as_py() == b.column(0)[0].as_py()
        if last or not goes_on:
            ready = [*held, b.slice(0, last)] if last else held
            if ready:
                yield swept(ready, False)
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield swept(held, True)


def _whole(t: pa.Table) -> pa.Table:
    """The sweep of one entity from its parts."""
    t = t.sort_by([("_run", "ascending"), ("_no", "ascending")])
    parts = t.select(["_id", "_at", "_seq", "_no", "_state"]).combine_chunks().to_batches()
    run = t["_run"][0].as_py()
    return pa.Table.from_batches(list(_sweep(run, iter(parts))))


_SWEPT = ["_run", "_no", "_id", "_at", "_seq", "_state", "_prev_no", "_prev_at", "_prev_state", "_until", "_open_before", "_open_behind", "_edge"]


def _settled(edge: DataFrame) -> DataFrame:
    """Writes of entities of several runs with the neighbours they have in other runs.

    Both sides are one question: ``_side`` is 1 for the neighbour before and -1 for the one behind, where runs and
    ticks count backwards; there a write must have arrived strictly earlier.
    """
    sides = F.explode(F.filter(F.array(F.when(F.col("_open_before"), 1), F.when(F.col("_open_behind"), -1)), lambda x: x.isNotNull()))
    bound = F.when(F.col("_side") > 0, F.col("_seq")).otherwise(F.col("_seq") - 1)
    least = edge.groupBy("_id", "_run").agg(F.min("_seq").alias("_least")).withColumn("_side", F.explode(F.array(F.lit(1), F.lit(-1))))
    least = least.withColumn("_place", F.col("_side") * F.col("_run"))
    own = Window.partitionBy("_id", "_side").orderBy("_place")
    least = cut(least.select(
        "_id", "_side", "_place", "_least",
        F.lag("_place").over(own).alias("_near"), F.lag("_least").over(own).alias("_near_least"),
        F.min("_least").over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("_all_least"),
    ))
    keys = ["_id", "_side", "_run", "_no", "_bound"]
    asked = edge.select("_id", "_run", "_no", "_seq", sides.alias("_side")).withColumn("_bound", bound).withColumn("_place", F.col("_side") * F.col("_run"))
    asked = asked.join(least.drop("_least"), ["_id", "_side", "_place"]).where("_all_least <= _bound")
    near = asked.where("_near_least <= _bound").select(*keys, F.col("_near").alias("_there"))
    # The next run has none that arrived before: the nearest one that has.
    others = least.select("_id", "_side", F.col("_place").alias("_far"), "_least")
    far = asked.where("_near_least > _bound").join(others, ["_id", "_side"]).where("_far < _place and _least <= _bound").groupBy(*keys).agg(F.max("_far").alias("_there"))
    # What a run shows on the side that faces the asking one holds the nearest write that arrived earlier.
    facing = F.explode(F.filter(F.array(F.when(F.col("_open_behind"), 1), F.when(F.col("_open_before"), -1)), lambda x: x.isNotNull()))
    seen = edge.select("_id", facing.alias("_side"), "_run", "_at", "_seq", "_no", "_state")
    seen = seen.select("_id", "_side", (F.col("_side") * F.col("_run")).alias("_there"), F.struct("_at", "_seq", "_no", "_run", "_state").alias("_w"))
    met = near.unionByName(far).join(seen, ["_id", "_side", "_there"]).where("_w._seq <= _bound")
    rank = F.struct(*[(F.col("_side") * F.col(f"_w.{c}")).alias(c) for c in ("_at", "_seq", "_no")])
    found = met.groupBy("_run", "_no").agg(
        F.max_by(F.when(F.col("_side") > 0, F.col("_w")), F.when(F.col("_side") > 0, rank)).alias("_before"),
        F.max_by(F.when(F.col("_side") < 0, F.col("_w._at")), F.when(F.col("_side") < 0, rank)).alias("_behind"),
    )
    return edge.join(found, ["_run", "_no"], "left").select(
        *[c for c in edge.columns if c not in ("_prev_no", "_prev_at", "_prev_state", "_until")],
        F.coalesce("_before._run", "_run").alias("_prev_run"),
        *[F.coalesce(f"_prev{c}", f"_before.{c}").alias(f"_prev{c}") for c in ("_no", "_at", "_state")],
        F.coalesce("_until", "_behind").alias("_until"),
    )


def _rows(df: DataFrame, entity: str, recorded: str, sequence: str, attributes: dict[str, Column], runs: int | None, run_rows: int) -> tuple[DataFrame, bool]:
    """Ledger rows with the place (_run, _no) of the write whose state they hold; whether an entity has several runs."""
    writes = df.select(
        F.col(entity).alias("_id"),
        F.col(recorded).cast("bigint").alias("_at"),
        F.coalesce(F.col(sequence).cast("bigint"), F.lit(NO_SEQUENCE)).alias("_seq"),
        F.struct(*[c.alias(k) for k, c in attributes.items()]).alias("_state"),
    ).where("_id is not null and _at is not null")
    writes = writes.select("_id", "_at", "_seq", F.xxhash64("_state").alias("_tie"), "_state")
    kind = {f.name: f.dataType.simpleString() for f in writes.schema.fields}
    types = ["bigint", "bigint", kind["_id"], "bigint", "bigint", kind["_state"], "bigint", "bigint", kind["_state"], "bigint", "boolean", "boolean", "boolean"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(_SWEPT, types, strict=True))
    swept = cut(in_runs(writes, ["_id", "_at", "_seq", "_tie"], _sweep, schema, runs))
    # Entities that begin and end inside a run are complete. One at a border that fits a run is swept again as a whole.
    edge = swept.where("_edge")
    large = edge.groupBy("_id").agg(F.count("*").alias("_n"), F.min("_run").alias("_lo"), F.max("_run").alias("_hi"))
    large = cut(large.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > run_rows)).select("_id"))
    several = not large.isEmpty()
    small = edge.join(large, "_id", "left_anti").select(*edge.columns) if several else edge
    one = swept.where("not _edge").unionByName(small.groupBy("_id").applyInArrow(_whole, schema))
    both = one.withColumn("_prev_run", F.col("_run")).withColumn("_edge", F.lit(False))
    if several:
        both = both.unionByName(cut(_settled(cut(edge.join(large, "_id", "left_semi").select(*edge.columns)))))
    row = lambda run, no, at, until, state: F.struct(run.alias("_run"), no.alias("_no"), at.alias("_at"), until.alias("_until"), state.alias("_state"))
    c = F.col
    own = row(c("_run"), c("_no"), c("_at"), c("_until"), c("_state"))
    shortened = F.when(c("_prev_no").isNotNull(), row(c("_prev_run"), c("_prev_no"), c("_prev_at"), c("_at"), c("_prev_state")))
    told = both.select("_id", "_edge", c("_seq").alias("_known"), F.explode(F.filter(F.array(own, shortened), lambda r: r.isNotNull())).alias("_r"))
    # One exchange serves the closing of rows by write and the joining of versions by entity.
    placed = told.select("_id", "_edge", "_known", "_r.*").repartition("_id", "_run")
    later = Window.partitionBy("_id", "_run", "_no").orderBy("_known", F.col("_until").desc_nulls_first())
    # A correction in the same tick leaves its predecessor nothing; a redelivered row closes the first at once.
    stands = (F.col("_until").isNull() | (F.col("_until") > F.col("_at"))) & (F.col("_known_to").isNull() | (F.col("_known_to") > F.col("_known")))
    return placed.withColumn("_known_to", F.lead("_known").over(later)).where(stands), several


def ledger(df: DataFrame, entity: str, recorded: str, sequence: str, attributes: dict[str, Column], open_end: int = OPEN_END, runs: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """(entity, version_from, version_to, recorded_from, recorded_to, *attributes); a null recorded_to is open."""
    return _rows(df, entity, recorded, sequence, attributes, runs, run_rows)[0].select(
        F.col("_id").alias(entity),
        F.col("_at").alias("version_from"),
        F.coalesce("_until", F.lit(open_end).cast("bigint")).alias("version_to"),
        F.col("_known").alias("recorded_from"),
        F.col("_known_to").alias("recorded_to"),
        "_state.*",
    )


def versions(df: DataFrame, entity: str, recorded: str, sequence: str, attributes: dict[str, Column], open_end: int = OPEN_END, runs: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """(entity, version_from, version_to, *attributes): the ledger's open rows, one row per version."""
    told, several = _rows(df, entity, recorded, sequence, attributes, runs, run_rows)
    standing = told.where("_known_to is null")
    own = Window.partitionBy("_id", "_run")
    swept = standing.withColumn("_before", F.lag(F.struct("_state")).over(own.orderBy("_at")))
    changed = F.col("_before").isNull() | ~F.col("_before._state").eqNullSafe(F.col("_state"))
    local = swept.withColumn("_first", F.col("_before").isNull()).where(changed)
    local = local.withColumn("_to", F.lead("_at").over(own.orderBy("_at"))).select("_id", "_run", "_edge", "_at", "_to", "_first", "_state")

    def done(v: DataFrame) -> DataFrame:
        return v.select(
            F.col("_id").alias(entity),
            F.col("_at").alias("version_from"),
            F.coalesce("_to", F.lit(open_end).cast("bigint")).alias("version_to"),
            "_state.*",
        )

    if not several:
        return done(local)
    # One row for each run of an entity that has several: its first change, and the state it begins and ends with.
    over = local.where("_edge")
    ends = over.groupBy("_id", "_run").agg(
        F.min_by("_state", "_at").alias("_begins"),
        F.max_by("_state", "_at").alias("_ends"),
        F.min("_at").alias("_first_at"),
        F.min(F.when(~F.col("_first"), F.col("_at"))).alias("_inner_at"),
    )
    up, down = Window.partitionBy("_id").orderBy("_run"), Window.partitionBy("_id").orderBy(F.desc("_run"))
    ends = ends.withColumn("_prev", F.lag(F.struct("_ends")).over(up))
    goes_on = F.col("_prev").isNotNull() & F.col("_prev._ends").eqNullSafe(F.col("_begins"))
    ends = ends.withColumn("_goes_on", goes_on).withColumn("_kept", F.when(goes_on, F.col("_inner_at")).otherwise(F.col("_first_at")))
    ends = ends.withColumn("_later", F.last("_kept", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    joined = over.join(ends.select("_id", "_run", "_goes_on", "_later"), ["_id", "_run"]).where(~(F.col("_first") & F.col("_goes_on")))
    joined = joined.withColumn("_to", F.coalesce("_to", "_later")).select(*local.columns)
    return done(local.where("not _edge").unionByName(joined))
