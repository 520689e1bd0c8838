"""References to records that do not exist: keyed pending-orphan state, advanced batch by batch in order of arrival.

State is keyed tables. ``parents`` has, per (kind, key), the tick from which the target exists and the tick from
which it is gone again; both merge by minimum, so late and repeated rows arrive in any order. ``pending`` has the
references that wait for a target, and only these are probed again. ``log`` has those that wait no more, each as it was
settled: 'settled' (its target was there), 'lost' (its target was gone already) or 'reopened' (a deletion told later
took its target away after all); it is only ever added to.

``advance`` takes one batch of any size: new references probe the parent index, arriving parents resolve (or
retract) waiting orphans, deletions reopen references that had a target. Any cut into batches gives the same orphans.

Defined cases: a null or empty key refers to nothing; keys are compared trimmed and in lower case; a
reference without a time is left out; a target row without a time never begins to exist; several equal keys
in one row count once, repeated rows each count; at the tick of its deletion a target is gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomill.common import col, cut, norm_key

PERIOD = 10_000


def scalar_refs(df: DataFrame, field: str, kind: str, key: str, seq: str, at: str) -> DataFrame:
    """References held in one string column."""
    return df.select(
        F.lit(field).alias("ref_field"),
        F.lit(kind).alias("kind"),
        F.col(seq).alias("ingest_seq"),
        norm_key(key).alias("ref_key"),
        F.col(at).cast("double").alias("ref_at"),
    ).where("ref_key is not null and ref_at is not null")


def array_refs(df: DataFrame, field: str, kind: str, keys: str, seq: str, at: str) -> DataFrame:
    """References held in an array column, each distinct key of a row once."""
    return df.where(F.col(at).isNotNull()).select(
        F.lit(field).alias("ref_field"),
        F.lit(kind).alias("kind"),
        F.col(seq).alias("ingest_seq"),
        F.explode(F.filter(F.array_distinct(F.transform(keys, norm_key)), lambda k: k.isNotNull())).alias("ref_key"),
        F.col(at).cast("double").alias("ref_at"),
    )


def parent_rows(df: DataFrame, kind: str, key: str, at: str, gone: str | None = None) -> DataFrame:
    """Target rows as they arrive; ``merge_parents`` folds those of one key."""
    return df.select(
        F.lit(kind).alias("kind"),
        norm_key(key).alias("key"),
        F.col(at).cast("double").alias("first_at"),
        (F.col(gone).cast("double") if gone else F.lit(None).cast("double")).alias("gone_at"),
    ).where("key is not null")


def merge_parents(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "key").agg(F.min("first_at").alias("first_at"), F.min("gone_at").alias("gone_at"))


def missing_at(at: str | Column) -> Column:
    """Whether the target of a watched reference does not exist at a tick."""
    at = col(at)
    return F.col("first_at").isNull() | (F.col("first_at") > at) | F.coalesce(F.col("gone_at") <= at, F.lit(False))


REF = ("ref_field", "kind", "ingest_seq", "ref_key", "ref_at")


@dataclass(frozen=True)
class OrphanState:
    parents: DataFrame
    pending: DataFrame
    log: DataFrame

    def orphans(self) -> DataFrame:
        """References whose target did not exist when they were made."""
        return self.pending.unionByName(self.log.where("status in ('lost', 'reopened')").select(*REF))

    def watched(self) -> DataFrame:
        """Every reference with what is known of its target."""
        return _probe(self.pending.unionByName(self.log.where("status in ('settled', 'lost')").select(*REF)), self.parents)

    def waiting(self, at: float) -> DataFrame:
        """References made until a tick whose target does not exist at that tick."""
        return self.watched().where((F.col("ref_at") <= at) & missing_at(F.lit(float(at))))


def _probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    # The references are the larger side and may be skewed; as the streamed side of a plain sort-merge or
    # hash join, oversized partitions are split by adaptive execution.
    p = parents.select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), "first_at", "gone_at")
    on = (F.col("kind") == F.col("_kind")) & (F.col("ref_key") == F.col("_key"))
    return refs.join(p, on, "left").drop("_kind", "_key")


def step(state: OrphanState | None, new_refs: DataFrame, new_parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new parent index, and the references that this batch settles or leaves waiting, with their status."""
    arrived = merge_parents(new_parents).withColumn("_before", F.lit(None).cast("double")).withColumn("_new", F.lit(True))
    index = arrived
    if state is not None:
        known = state.parents.withColumn("_before", F.col("gone_at")).withColumn("_new", F.lit(False))
        index = known.unionByName(arrived).groupBy("kind", "key").agg(
            *[F.min(c).alias(c) for c in ("first_at", "gone_at", "_before")], F.max("_new").alias("_new")
        )
    index = cut(index)
    asking = new_refs.select(*REF) if state is None else state.pending.unionByName(new_refs.select(*REF))
    gone = F.coalesce(F.col("gone_at") <= F.col("ref_at"), F.lit(False))
    status = F.when(gone, "lost").when(F.col("first_at") <= F.col("ref_at"), "settled").otherwise("pending")
    moved = _probe(asking, index).select(*REF, status.alias("status"))
    if state is not None:
        # Only a deletion that was not known, or not so early, takes away a target that was there.
        earlier = index.where("_new and gone_at is not null and (_before is null or gone_at < _before)")
        p = earlier.select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), "gone_at", "_before")
        on = (F.col("kind") == F.col("_kind")) & (F.col("ref_key") == F.col("_key"))
        taken = state.log.where("status = 'settled'").join(p, on).where("gone_at <= ref_at and (_before is null or _before > ref_at)")
        moved = moved.unionByName(taken.select(*REF, F.lit("reopened").alias("status")))
    return index.select("kind", "key", "first_at", "gone_at"), moved


def advance(state: OrphanState | None, new_refs: DataFrame, new_parents: DataFrame) -> OrphanState:
    """Take one batch of references and target rows into the state, which is written."""
    parents, moved = step(state, new_refs, new_parents)
    moved = cut(moved)
    log = moved.where("status <> 'pending'")
    return OrphanState(parents, moved.where("status = 'pending'").select(*REF), log if state is None else state.log.unionByName(log))


def replay(refs: DataFrame, parents: DataFrame, batch: str, n_batches: int) -> OrphanState:
    """The state after all batches, numbered from 0 in the column ``batch`` of both tables."""
    state = None
    for k in range(n_batches):
        here = F.col(batch) == k
        state = advance(state, refs.where(here), parents.where(here))
    return state


def snapshots(state: OrphanState, period: int = PERIOD) -> DataFrame:
    """Per field and period: orphan references made, by reason, and how many waiting ones were resolved,
    reopened and left waiting at the period's end.

    Every watched reference gives at most three events; they are counted per field and period before the
    shuffle, so only a table of fields times periods is ever sorted.
    """
    first, gone, at = F.col("first_at"), F.col("gone_at"), F.col("ref_at")
    begin = F.greatest(first, at)
    stays = gone.isNull() | (gone > begin)
    event = lambda kind, tick, when: F.when(when, F.struct(F.lit(kind).alias("event"), tick.alias("tick")))
    events = F.array(
        event("never", at, first.isNull()),
        event("deleted", at, first.isNotNull() & (gone <= at)),
        event("later", at, first.isNotNull() & (first > at) & ~F.coalesce(gone <= at, F.lit(False))),
        event("resolved", first, (first > at) & stays),
        event("reopened", gone, first.isNotNull() & gone.isNotNull() & (gone > begin)),
    )
    rows = (
        state.watched().select("ref_field", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
        .select("ref_field", F.floor(F.col("e.tick") / period).cast("bigint").alias("period"), F.col("e.event").alias("event"))
        .groupBy("ref_field", "period")
        .agg(*[F.count_if(F.col("event") == k).alias(f"n_{k}") for k in ("never", "deleted", "later", "resolved", "reopened")])
    )
    so_far = Window.partitionBy("ref_field").orderBy("period")
    made = F.col("n_never") + F.col("n_deleted") + F.col("n_later")
    return rows.withColumn("n_orphans", made).withColumn(
        "n_waiting", F.sum(made + F.col("n_reopened") - F.col("n_resolved")).over(so_far)
    )
