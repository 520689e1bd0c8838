"""Fragments of DuckDB SQL that several oracles share."""

from __future__ import annotations

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
MARK = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def key(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')), '')"


def words(c: str) -> str:
    """Pieces between white space."""
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}+'), lambda x: x <> '')"


def tokens(c: str, least: int = 1) -> str:
    found = f"regexp_extract_all(lower({c}), '{WORD}+')"
    return f"list_filter({found}, lambda x: length(x) >= {least})" if least > 1 else found


# State of the record store after all writes, with supersession in arrival order.
REPLAY = f"""
w as (
  select ingest_seq, id, coalesce(task_scope, 'global') as task_scope, coalesce(statement, '') as statement, created_at, coalesce(valid_from, created_at) as valid_from,
    coalesce(valid_to, 999999999) as valid_to, {key('supersedes')} as supersedes, coalesce(upper(trim(status)), 'ACTIVE') as status,
    coalesce(role_tags, []) as role_tags, coalesce(artifact_hash, '') as artifact_hash
  from memory_records
), last as (select * from w qualify row_number() over (partition by id order by ingest_seq desc) = 1),
closed as (
  select l.id, min(c.created_at) as tick from w c join last l on c.supersedes = l.id
  where c.ingest_seq > l.ingest_seq and c.created_at < l.valid_to group by 1
), store as (
  select l.* exclude (status, valid_to), case when c.tick is not null then 'SUPERSEDED' else status end as status, coalesce(c.tick, valid_to) as valid_to
  from last l left join closed c on c.id = l.id
)"""

# First deliveries of the v1 store.
DELIVERIES = f"""
d as (
  select * exclude (supersedes, depends_on, valid_to, status, role_tags), {key('supersedes')} as supersedes, coalesce(valid_to, 'infinity'::double) as valid_to,
    upper(trim(status)) as status, coalesce(role_tags, []) as role_tags
  from memory_records_v1 where memory_id <> '' qualify row_number() over (partition by memory_id order by ingest_seq) = 1
)"""


def bm25(source: str, terms: list[str], toks: str, length: str, least: str = "greatest(1.0, avg(dl))") -> str:
    """CTEs ``t`` (tokens and length), ``s`` (statistics) and ``scored`` over a source that has ``columns``."""
    distinct = list(dict.fromkeys(terms))
    stats = ", ".join(f"count(*) filter (list_contains(tk, '{x}')) as df{i}" for i, x in enumerate(distinct))
    tf = lambda x: f"len(list_filter(tk, lambda y: y = '{x}'))::double"
    term = lambda x: (
        f"(case when df{distinct.index(x)} = 0 then 0 else ln(1.0::double + (n - df{distinct.index(x)} + 0.5::double) / (df{distinct.index(x)} + 0.5::double))"
        f" * ({tf(x)} * 2.5::double) / greatest({tf(x)} + 1.5::double * (0.25::double + 0.75::double * dl / mean), 1e-6::double) end)"
    )
    score = " + ".join(term(x) for x in terms) or "0.0"
    return f"""
t as (select *, {toks} as tk, len({length})::double as dl from {source}),
s as (select count(*) as n, {least} as mean, {stats} from t),
scored as (select t.*, {score} as score from t cross join s)"""
