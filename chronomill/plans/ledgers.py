"""Queries on record journals: orphans (p2), histories (p3), hierarchies (p5), as-of attributes (p6), periods (p7)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import OPEN_END, WHITE_SPACE, cut, norm_key, table
from chronomill.operators import asof, hierarchy, history, intervals, references


BATCHES = 2


def _entry(field: str | None, kind: str, key: Column) -> Column:
    return F.struct(F.lit(field).cast("string").alias("ref_field"), F.lit(kind).alias("kind"), key.alias("ref_key"), F.lit(field is None).alias("is_parent"))


def _referring(field: str, kind: str) -> Callable[[Column], Column]:
    return lambda key: _entry(field, kind, key)


def _arrivals(df: DataFrame, seq: str, at: str, gone: str | None, parent: tuple[str, str], refs: list[tuple[str, str, str]]) -> DataFrame:
    """Targets and references of a table from one scan, a row for each. ``parent``: kind and key; ``refs``: field, kind, column."""
    parts = [F.array(_entry(None, parent[0], norm_key(parent[1])))]
    for field, kind, column in refs:
        several = df.schema[column].dataType.typeName() == "array"
        keys = F.coalesce(F.array_distinct(F.transform(column, norm_key)), F.array().cast("array<string>")) if several else F.array(norm_key(column))
        parts.append(F.transform(keys, _referring(field, kind)))
    rows = df.select(
        F.col(seq).alias("ingest_seq"), F.col(at).cast("double").alias("ref_at"), (F.col(gone) if gone else F.lit(None)).cast("double").alias("gone_at"),
        F.explode(F.concat(*parts)).alias("_e"),
    )
    return rows.select("ingest_seq", "ref_at", "gone_at", "_e.*").where("ref_key is not null and (is_parent or ref_at is not null)")


def arrivals(spark: SparkSession, d: str, n_batches: int) -> DataFrame:
    """References and target rows of all tables with the number of the batch they arrive in.

    Journals arrive in the order of ``ingest_seq``. Evidence has no sequence: a row arrives at the latest tick it tells
    of. Batches are equal spans of either.
    """
    records, v1, evidence = (table(spark, d, t) for t in ("memory_records", "memory_records_v1", "evidence"))
    told = F.greatest("recorded_at", "deleted_at")
    evidence = evidence.withColumn("_told", told)
    sources = [
        _arrivals(records, "ingest_seq", "created_at", None, ("record", "id"), [("evidence_ids", "evidence", "evidence_ids"), ("supersedes", "record", "supersedes")]),
        _arrivals(v1, "ingest_seq", "observed_at", None, ("record_v1", "memory_id"), [("depends_on", "record_v1", "depends_on")]),
        _arrivals(evidence, "_told", "recorded_at", "deleted_at", ("evidence", "evidence_id"), []),
    ]
    ends = [df.select(F.lit(k).alias("k"), F.col(c).cast("double").alias("c")) for k, (df, c) in enumerate(((records, "ingest_seq"), (v1, "ingest_seq"), (evidence, "_told")))]
    spans = {r.k: (r.lo or 0.0, (r.hi or 0.0) + 1.0) for r in reduce(DataFrame.unionByName, ends).groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).collect()}
    numbered = []
    for k, rows in enumerate(sources):
        lo, hi = spans.get(k, (0.0, 1.0))
        share = (F.coalesce(F.col("ingest_seq").cast("double"), F.lit(lo)) - lo) / (hi - lo)
        numbered.append(rows.withColumn("batch", F.floor(share * n_batches).cast("int")))
    return reduce(DataFrame.unionByName, numbered)


def orphan_state(spark: SparkSession, d: str, n_batches: int = BATCHES) -> references.OrphanState:
    log = cut(arrivals(spark, d, n_batches))
    parents = log.where("is_parent").select("batch", "kind", F.col("ref_key").alias("key"), F.col("ref_at").alias("first_at"), "gone_at")
    return references.replay(log.where("not is_parent").select("batch", *references.REF), parents, "batch", n_batches)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_state(spark, d).orphans().select("ref_field", "ingest_seq", "ref_key")


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return references.snapshots(orphan_state(spark, d))


def _attributes() -> dict:
    return {
        "valid_from": F.col("valid_from"),
        "valid_to": F.coalesce("valid_to", F.lit(OPEN_END)).cast("bigint"),
        "supersedes": norm_key("supersedes"),
        "status": F.lower(F.btrim(F.col("status"), F.lit(WHITE_SPACE))),
    }


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    return history.versions(table(spark, d, "memory_records"), "id", "created_at", "ingest_seq", _attributes())


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """All rows the ledger ever told: periods of ticks as known over periods of arrival."""
    return history.ledger(table(spark, d, "memory_records"), "id", "created_at", "ingest_seq", _attributes())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_history(spark, d).select("id", "version_from", "version_to")


def _links(spark: SparkSession, d: str, paths: bool, ways: bool = False) -> DataFrame:
    v1 = table(spark, d, "memory_records_v1")
    return hierarchy.walks(v1, "memory_id", "ingest_seq", {"supersedes": "supersedes", "depends_on": "depends_on"}, paths, ways=ways)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, False).select(
        "link", F.col("node").alias("memory_id"), F.col("anc").alias("root_id"), F.col("dist").alias("depth")
    )


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root down, depth and root per record; for a walk into a cycle the part below it."""
    return _links(spark, d, True).select(
        "link",
        F.col("node").alias("memory_id"),
        F.col("anc").alias("root_id"),
        F.col("dist").alias("depth"),
        (F.col("kind") == hierarchy.CYCLE).alias("is_cyclic"),
        F.array_join(F.reverse(F.when(F.col("kind") == hierarchy.ROOT, F.concat("path", F.array("anc"))).otherwise(F.col("path"))), " > ").alias("path"),
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each record with every other record below it, also through cycles: members of a cycle list each other."""
    ends = F.when(F.col("kind") == hierarchy.ROOT, F.array_union("via", F.array("anc"))).otherwise(F.col("via"))
    return (
        _links(spark, d, True, True)
        .select("link", F.explode(ends).alias("memory_id"), F.col("node").alias("descendant_id"))
        .distinct()
    )


def p6_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Events with the attributes of their record that stood and were valid at the event's tick."""
    known = asof.as_known(
        table(spark, d, "episode_events"), table(spark, d, "memory_records"),
        "event_id", "record_id", "as_of", {"task_id": "task_id", "as_of": "as_of"},
        "id", "created_at", "ingest_seq",
        {"task_scope": "task_scope", "valid_from": "valid_from", "valid_to": "valid_to", "status": "status"},
    )
    return known.where(
        (F.col("task_scope").eqNullSafe("global") | (F.col("task_scope") == F.col("task_id")))
        & (F.col("valid_from") <= F.col("as_of"))
        & (F.coalesce("valid_to", F.lit(OPEN_END)) > F.col("as_of"))
    ).select("event_id", F.col("_write_seq").alias("ingest_seq"), "as_of", F.col("_write_at").alias("created_at"), "valid_from", "valid_to", "status")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_attributes(spark, d).select("event_id", "ingest_seq")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    v1 = table(spark, d, "memory_records_v1")
    return intervals.periods_and_gaps(v1, "artifact_uri", "valid_from", "valid_to", scale=1000).select(
        "artifact_uri", "kind", F.col("from_at").alias("from_milli"), F.col("to_at").alias("to_milli")
    )


def orphans_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Orphans from a state that is advanced in more and smaller batches."""
    return orphan_state(spark, d, 2 * BATCHES).orphans().select("ref_field", "ingest_seq", "ref_key")


QUERIES = {
    "orphans_incremental": orphans_incremental,
    "p2_found": p2_found,
    "p2_periods": p2_periods,
    "p3_found": p3_found,
    "p3_history": p3_history,
    "p3_ledger": p3_ledger,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
    "p6_found": p6_found,
    "p6_attributes": p6_attributes,
    "p7_found": p7_found,
}

def _key(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}]+$', '', 'g')), '')"


ORPHANS_SQL = f"""
with refs as (
  select 'evidence_ids' as ref_field, 'e' as kind, ingest_seq, created_at::double as tk,
         unnest(list_distinct(list_transform(evidence_ids, lambda x: {_key('x')}))) as ref_key from memory_records
  union all
  select 'supersedes', 'r', ingest_seq, created_at::double, {_key('supersedes')} from memory_records
  union all
  select 'depends_on', 'v', ingest_seq, observed_at,
         unnest(list_distinct(list_transform(depends_on, lambda x: {_key('x')}))) from memory_records_v1
), parents as (
  select 'e' as kind, evidence_id as key, min(recorded_at)::double as first_at, min(deleted_at)::double as gone_at from evidence group by all
  union all select 'r', id, min(created_at)::double, null from memory_records group by all
  union all select 'v', memory_id, min(observed_at), null from memory_records_v1 group by all
), watched as (
  select r.*, p.first_at, p.gone_at from refs r left join parents p on p.kind = r.kind and p.key = r.ref_key
  where r.ref_key is not null and r.tk is not null
)"""

_COUNTING = """
w as (
  select *, coalesce(valid_to, 999999999) as vt, {sup} as sup, {st} as st from memory_records
  qualify row_number() over (partition by id, created_at order by ingest_seq desc) = 1
)"""

_FOUND = " select ref_field, ingest_seq, ref_key from watched where first_at is null or first_at > tk or coalesce(gone_at <= tk, false)"

_VERSIONS = "with" + _COUNTING.format(sup=_key("supersedes"), st="lower(trim(status))") + """, c as (
  select * from w window o as (partition by id order by created_at) qualify lag(created_at) over o is null or lag(valid_from) over o is distinct from valid_from or lag(vt) over o is distinct from vt
    or lag(sup) over o is distinct from sup or lag(st) over o is distinct from st
), v as (select *, created_at as version_from, coalesce(lead(created_at) over (partition by id order by created_at), 999999999) as version_to from c)"""

_WALKS = f"""
with recursive ids as (select distinct memory_id as id from memory_records_v1 where memory_id <> ''),
e as (
  select distinct link, child, parent from (
    select 'supersedes' as link, memory_id as child, {_key('supersedes')} as parent from memory_records_v1
    union all select 'depends_on', memory_id, {_key('u')} from (select memory_id, unnest(depends_on) as u from memory_records_v1))
  where parent in (select id from ids)
), reach as (select link, child, parent from e union select r.link, r.child, e.parent from reach r join e on e.link = r.link and e.child = r.parent),
cyc as (select a.link, a.child as id, min(a.parent) as least from reach a join reach b on a.link = b.link and a.child = b.parent and a.parent = b.child group by all),
walk as (
  select e.link, e.child, e.parent as at, 1::bigint as depth from e where (e.link, e.child) not in (select (link, id) from cyc)
  union select w.link, w.child, e.parent, w.depth + 1 from walk w join e on e.link = w.link and e.child = w.at where (w.link, w.at) not in (select (link, id) from cyc)
)"""

ORACLES = {
    "orphans_incremental": ORPHANS_SQL + _FOUND,
    "p3_history": _VERSIONS + " select id, version_from, version_to, valid_from, vt as valid_to, sup as supersedes, st as status from v",
    "p5_found": _WALKS + """
select link, id as memory_id, least as root_id, -1::bigint as depth from cyc
union select w.link, w.child, c.least, -1 from walk w join cyc c on c.link = w.link and c.id = w.at
union select w.link, w.child, w.at, w.depth from walk w where (w.link, w.at) not in (select (link, id) from cyc) and (w.link, w.at) not in (select (link, child) from e)""",
    "p5_descendants": _WALKS + " select distinct link, parent as memory_id, child as descendant_id from reach where child <> parent",
    "p5_paths": _WALKS + """, way as (
  select link, child, child as at, 0::bigint as depth, [child] as path from e union
  select w.link, w.child, e.parent, w.depth + 1, list_append(w.path, e.parent) from way w join e on e.link = w.link and e.child = w.at where (w.link, w.at) not in (select (link, id) from cyc)
), ends as (
  select w.link, w.child, c.least as root, -1::bigint as depth, true as is_cyclic, w.path from way w join cyc c on c.link = w.link and c.id = w.at
  union all select way.link, way.child, way.at, way.depth, false, way.path from way where way.depth > 0 and (way.link, way.at) not in (select (link, id) from cyc) and (way.link, way.at) not in (select (link, child) from e)
) select link, child as memory_id, root as root_id, depth, is_cyclic, array_to_string(list_reverse(min(path)), ' > ') as path from ends group by all""".replace("group by all", "group by link, child, root, depth, is_cyclic"),
    "p6_attributes": f"""
with e as (select distinct event_id, task_id, as_of, {_key('record_id')} as rid from episode_events),
w as (select * from memory_records qualify row_number() over (partition by id, created_at order by ingest_seq desc) = 1)
select event_id, ingest_seq, as_of, created_at, valid_from, valid_to, status from e asof join w on e.rid = w.id and e.as_of >= w.created_at
where (task_scope = 'global' or task_scope = task_id) and valid_from <= as_of and as_of < coalesce(valid_to, 999999999)""",
    "p2_found": ORPHANS_SQL
    + _FOUND,
    "p2_periods": ORPHANS_SQL
    + """, events as (
  select ref_field, tk as tick, case when first_at is null then 'never' when gone_at <= tk then 'deleted' when first_at > tk then 'later' end as event from watched
  union all select ref_field, first_at, 'resolved' from watched where first_at > tk and (gone_at is null or gone_at > first_at)
  union all select ref_field, gone_at, 'reopened' from watched where first_at is not null and gone_at > greatest(first_at, tk)
), counts as (
  select ref_field, floor(tick / 10000)::bigint as period, count(*) filter (event = 'never') as n_never, count(*) filter (event = 'deleted') as n_deleted,
    count(*) filter (event = 'later') as n_later, count(*) filter (event = 'resolved') as n_resolved, count(*) filter (event = 'reopened') as n_reopened
  from events where event is not null group by all
)
select *, n_never + n_deleted + n_later as n_orphans,
  sum(n_never + n_deleted + n_later + n_reopened - n_resolved) over (partition by ref_field order by period)::bigint as n_waiting from counts""",
    "p3_ledger": f"""
with w as (select id, created_at as t, ingest_seq as q, valid_from, coalesce(valid_to, 999999999) as valid_to, {_key('supersedes')} as supersedes, lower(trim(status)) as status from memory_records),
told as (
  select id, q as w, t as a, (select min(b.t) from w b where b.id = x.id and b.t > x.t and b.q < x.q) as b, q as k from w x
  union all
  select x.id, (select arg_max(p.q, struct_pack(t := p.t, q := p.q)) from w p where p.id = x.id and p.t <= x.t and p.q < x.q) as w,
    (select max(p.t) from w p where p.id = x.id and p.t <= x.t and p.q < x.q) as a, x.t as b, x.q as k from w x
), closed as (select *, lead(k) over (partition by id, w order by k) as k2 from told where w is not null)
select c.id, a as version_from, coalesce(b, 999999999) as version_to, k as recorded_from, k2 as recorded_to, valid_from, valid_to, supersedes, status
from closed c join w on w.id = c.id and w.q = c.w where b is null or b > a""",
    "p3_found": _VERSIONS + " select id, version_from, version_to from v",
    "p6_found": f"""
with e as (select distinct event_id, task_id, as_of, {_key('record_id')} as rid from episode_events),
w as (select * from memory_records qualify row_number() over (partition by id, created_at order by ingest_seq desc) = 1)
select event_id, ingest_seq from e asof join w on e.rid = w.id and e.as_of >= w.created_at
where (task_scope = 'global' or task_scope = task_id) and valid_from <= as_of and as_of < coalesce(valid_to, 999999999)""",
    "p7_found": """
with i as (
  select artifact_uri, valid_from as s, coalesce(valid_to, 'infinity'::double) as e, ingest_seq from memory_records_v1
  where artifact_uri <> '' and valid_from is not null and coalesce(valid_to, 'infinity'::double) > valid_from
), f as (
  select *, coalesce(s > max(e) over (partition by artifact_uri order by s, e, ingest_seq rows between unbounded preceding and 1 preceding), true) as fresh from i
), g as (select *, sum(fresh::int) over (partition by artifact_uri order by s, e, ingest_seq rows unbounded preceding) as grp from f),
p as (select artifact_uri, grp, min(s) as s, max(e) as e from g group by all),
r as (select artifact_uri, 'period' as kind, s, e from p union all
  select artifact_uri, 'gap', e, n from (select *, lead(s) over (partition by artifact_uri order by s) as n from p) where n is not null)
select artifact_uri, kind, round(s * 1000)::bigint as from_milli, case when isinf(e) then -1 else round(e * 1000)::bigint end as to_milli from r""",
}
