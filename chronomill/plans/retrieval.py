"""Retrieval queries: the legacy and v1 stores, baselines, code chunks, packing and budgets."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import table
from chronomill.functions import code
from chronomill.functions import text as tx
from chronomill.operators import retrieval as ret
from chronomill.operators import store
from chronomill.plans import sql
from chronomill.plans.store import _WORKSPACE, _files, legacy_state, v1_records

# The literal queries that the named plans ask.
QUESTION, ROLE, TICK, SCOPE = "Do not route the schedule: the policy lock of the queue is already held.", "coder", 60_000, "task_shared_release_train"
HASH = "e06a91c6"
CODE_QUESTION = "return the ordered queue of the bundle items"
TERMS = ret.store_terms(QUESTION)


def _legacy(spark: SparkSession, d: str, method: str, budget: int = 512) -> DataFrame:
    got = ret.retrieve_legacy(legacy_state(spark, d), QUESTION, ROLE, TICK, SCOPE, None, method, budget)
    return got.select("id", F.round("score", 6).alias("score"), "created_at")


def _pick(df: DataFrame) -> DataFrame:
    return df.select("rank", "memory_id", F.round("score", 6).alias("score"))


def b0_none(spark: SparkSession, d: str) -> DataFrame:
    return v1_records(spark, d).where(F.lit(False)).select("memory_id", "statement")


def b1_recent(spark: SparkSession, d: str) -> DataFrame:
    return v1_records(spark, d).orderBy(F.desc_nulls_last("observed_at"), F.asc("ingest_seq")).limit(10).select("memory_id", "observed_at")


def b2_chronological(spark: SparkSession, d: str) -> DataFrame:
    return v1_records(spark, d).orderBy(F.asc_nulls_first("observed_at"), F.asc("ingest_seq")).select("memory_id", "observed_at")


def b3_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _pick(ret.retrieve(v1_records(spark, d), QUESTION, ROLE, TICK, 10, use_validity=False, use_role_bonus=False))


def b4_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _pick(ret.retrieve(v1_records(spark, d), QUESTION, ROLE, TICK, 10, use_role_bonus=False))


def b5_superseded(spark: SparkSession, d: str) -> DataFrame:
    return _pick(ret.retrieve(store.propagated(v1_records(spark, d)), QUESTION, ROLE, TICK, 10, use_role_bonus=False))


def retrieve_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Direct supersession, validity, BM25, role bonus, top ten."""
    return _pick(ret.retrieve(store.superseded(v1_records(spark, d)), QUESTION, ROLE, TICK, 10))


def retrieve_full(spark: SparkSession, d: str) -> DataFrame:
    """Supersession with its propagation, symbol digests of the workspace (a missing file is no valid one), validity, BM25, role bonus, top ten."""
    files = _files(spark, d)
    r = store.symbol_valid(store.propagated(v1_records(spark, d)), files, code.symbol_digests(files, "path", "content"))
    return _pick(ret.retrieve(r, QUESTION, ROLE, TICK, 10, valid_column="symbol_valid"))


def retrieve_file_valid(spark: SparkSession, d: str) -> DataFrame:
    """Direct supersession and digests of whole files instead of symbols."""
    r = store.artifact_valid(store.superseded(v1_records(spark, d)), _files(spark, d))
    return _pick(ret.retrieve(r, QUESTION, ROLE, TICK, 10, valid_column="artifact_valid"))


def legacy_hash(spark: SparkSession, d: str) -> DataFrame:
    """The full method where records bound to another artifact than the present one are left out."""
    got = ret.retrieve_legacy(legacy_state(spark, d), QUESTION, ROLE, TICK, SCOPE, HASH, "full", 512)
    return got.select("id", F.round("score", 6).alias("score"), "created_at", "artifact_hash")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return ret.chunks(store.workspace(table(spark, d, "task_environments")))


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("task_id", "path", "start_line", "end_line", F.md5("code").alias("code_md5"))


def chunk_ranking(spark: SparkSession, d: str) -> DataFrame:
    scored = ret.chunk_bm25(_chunks(spark, d), CODE_QUESTION).where("score > 0")
    top = scored.orderBy(F.desc(F.round("score", 9)), "task_id", "path", "start_line").limit(20)
    return top.select("task_id", "path", "start_line", F.round("score", 6).alias("score"))


def packed_context(spark: SparkSession, d: str) -> DataFrame:
    got = ret.packed(ret.chunk_bm25(_chunks(spark, d), CODE_QUESTION), 1200, ["task_id", "path", "start_line"])
    return got.select("rank", "task_id", "path", "start_line", "n_tokens", "truncated")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return ret.retrieve(v1_records(spark, d), QUESTION, ROLE, TICK, 200)


def budget_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ret.budgeted(_ranked(spark, d)).select("budget", "rank", "memory_id", F.md5("line").alias("line_md5"), "truncated")


def tiny_budget(spark: SparkSession, d: str) -> DataFrame:
    return ret.budgeted(_ranked(spark, d), (15, 20, 30)).select("budget", "rank", "line", "truncated")


def memory_block(spark: SparkSession, d: str) -> DataFrame:
    return ret.memory_block(ret.retrieve(v1_records(spark, d), QUESTION, ROLE, TICK, 5))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        ret.estimated_tokens(F.col("text")).alias("n_estimated"),
        F.size(tx.simple_tokens("text")).alias("n_simple"),
        F.md5(ret.first_tokens(F.col("text"), 50)).alias("first_md5"),
    )


QUERIES = {
    **{f"legacy_{m}": partial(_legacy, method=m) for m in ret.METHODS},
    "b0_none": b0_none,
    "b1_recent": b1_recent,
    "b2_chronological": b2_chronological,
    "b3_bm25": b3_bm25,
    "b4_temporal": b4_temporal,
    "b5_superseded": b5_superseded,
    "retrieve_full": retrieve_full,
    "retrieve_superseded": retrieve_superseded,
    "retrieve_file_valid": retrieve_file_valid,
    "legacy_hash": legacy_hash,
    "code_chunks": code_chunks,
    "chunk_ranking": chunk_ranking,
    "packed_context": packed_context,
    "budget_sweep": budget_sweep,
    "tiny_budget": tiny_budget,
    "memory_block": memory_block,
    "token_counts": token_counts,
}

_VALID = f"status = 'ACTIVE' and valid_from <= {TICK} and {TICK} < valid_to"
_BONUS = f"(case when list_contains(role_tags, '{ROLE}') then 2.0::double else 0.0::double end)"


def _v1_sql(where: str = "true", bonus: str = "0.0", k: int = 10, source: str = "d", before: str = "") -> str:
    cte = sql.bm25("c", TERMS, sql.tokens("statement", 2), sql.words("statement"))
    return f"""with {sql.DELIVERIES.strip()}{before}, c as (select * from {source} where {where}), {cte},
r as (select *, score + {bonus} as total from scored)
select row_number() over (order by round(total, 9) desc, ingest_seq) as rank, memory_id, round(total, 6) as score, ingest_seq from r order by rank limit {k}"""


def _picked(q: str) -> str:
    return f"select rank, memory_id, score from ({q})"


_SUPERSEDED = """, hit as (select p.memory_id, min(c.valid_from) as tick from d c join d p on c.supersedes = p.memory_id where c.ingest_seq >= p.ingest_seq group by 1),
sd as (select d.* exclude (status, valid_to), case when h.memory_id is not null then 'SUPERSEDED' else status end as status, least(valid_to, h.tick) as valid_to
from d left join hit h on h.memory_id = d.memory_id)"""


def _legacy_sql(method: str, budget: int = 512, more: str = "", shown: str = "") -> str:
    q = sorted(set(QUESTION.lower().split()))
    listed = "[" + ", ".join(f"'{w}'" for w in q) + "]"
    valid = "true" if method in ("no_validity", "recent", "raw") else f"valid_from <= {TICK} and {TICK} < valid_to and status <> 'SUPERSEDED'"
    bonus = "0.0" if method in ("no_role_bonus", "bm25", "recent", "raw") else f"(case when list_contains(role_tags, '{ROLE}') or list_contains(role_tags, 'all') then 0.5 else 0.0 end)"
    return f"""with {sql.REPLAY.strip()}, c as (
  select *, len(list_intersect({listed}, {sql.words('lower(statement)')}))::double / {len(q)}.0::double + {bonus}::double as score
  from store where task_scope in ('global', '{SCOPE}') and {valid}{more}
), r as (select *, sum(length(statement)) over (order by score desc, created_at desc, id desc rows unbounded preceding) as spent from c)
select id, round(score, 6) as score, created_at{shown} from r where spent <= {budget * 4}"""


_FILES = """m as (
  select task_id, 0 as layer, unnest(map_entries(initial_workspace)) as f from task_environments
  union all select task_id, 1, unnest(map_entries(workspace_transition)) from task_environments
), ws as (
  select task_id, f.key as path, replace(replace(f.value, e'\\r\\n', e'\\n'), e'\\r', e'\\n') as content from m qualify row_number() over (partition by task_id, f.key order by layer desc) = 1
), l as (
  select task_id, path, case when content = '' then [] else string_split(regexp_replace(content, '\\n$', ''), e'\\n') end as ls from ws where content is not null
), ch as (
  select task_id, path, st + 1 as start_line, least(len(ls), st + 40) as end_line, array_to_string(ls[st + 1 : st + 40], e'\\n') as code
  from (select *, unnest(range(0, greatest(1, len(ls)), 40)) as st from l)
)"""
_CODE_TERMS = CODE_QUESTION.lower().split()
_CODE_TOKENS = f"list_filter({sql.tokens("path || e'\\n' || code")}, lambda x: regexp_full_match(x, '[a-z0-9_]+'))"


def _simple(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{sql.WORD}+|{sql.MARK}'))"


_CHUNK_SCORES = f"with {_FILES}, " + sql.bm25("ch", _CODE_TERMS, _CODE_TOKENS, "tk", "avg(dl)").strip()

_LINE = """'- **' || r.memory_id || '** (' || artifact_type || ')' || case when artifact_uri <> '' then ' [Artifact: ' || artifact_uri || ']' else '' end || ': ' || coalesce(statement, '')
  || case when evidence_ref <> '' then ' [Evidence: ' || evidence_type || ' (' || evidence_ref || ')]' else '' end"""

ORACLES = {
    **{f"legacy_{m}": _legacy_sql(m) for m in ret.METHODS},
    "b0_none": "select memory_id, statement from memory_records_v1 where false",
    "b1_recent": f"with {sql.DELIVERIES} select memory_id, observed_at from d order by observed_at desc nulls last, ingest_seq limit 10",
    "b2_chronological": f"with {sql.DELIVERIES} select memory_id, observed_at from d order by observed_at nulls first, ingest_seq",
    "b3_bm25": _picked(_v1_sql()),
    "b4_temporal": _picked(_v1_sql(_VALID)),
    "legacy_hash": _legacy_sql("full", more=f" and artifact_hash in ('', '{HASH}')", shown=", artifact_hash"),
    "retrieve_superseded": _picked(_v1_sql(_VALID, _BONUS, source="sd", before=_SUPERSEDED)),
    "retrieve_file_valid": _picked(_v1_sql(_VALID + " and artifact_valid", _BONUS, source="av", before=f"""{_SUPERSEDED}, {_WORKSPACE.strip()},
av as (select sd.*, case when coalesce(artifact_digest, '') = '' or coalesce(artifact_uri, '') = '' then true else coalesce(sha256(content) = artifact_digest, false) end as artifact_valid
  from sd left join files on path = artifact_uri)""")),
    "code_chunks": f"with {_FILES} select task_id, path, start_line, end_line, md5(code) as code_md5 from ch",
    "chunk_ranking": _CHUNK_SCORES + " select task_id, path, start_line, round(score, 6) as score from scored where score > 0 order by round(score, 9) desc, task_id, path, start_line limit 20",
    "packed_context": _CHUNK_SCORES
    + f""", k as (
  select *, row_number() over o as rank, {_simple("'[REPOSITORY CONTEXT (RETRIEVED)]'")} + sum(nt) over (o rows unbounded preceding) as spent from (
    select *, {_simple("'# File: ' || path || ' (Lines ' || start_line || '-' || end_line || ')' || e'\\n' || code || e'\\n\\n'")} as nt from scored where score > 0)
  window o as (order by round(score, 9) desc, task_id, path, start_line)
), f as (select *, min(rank) filter (spent > 1200) over () as first_over from k)
select rank, task_id, path, start_line, least(nt, 1200 - (spent - nt))::bigint as n_tokens, spent > 1200 as truncated from f
where spent <= 1200 or (rank = first_over and 1200 - (spent - nt) > 100)""",
    "budget_sweep": f"""with q as ({_v1_sql(_VALID, _BONUS, 200)}), j as (
  select q.rank, r.*, {_LINE} as line from q join (select * from memory_records_v1 qualify row_number() over (partition by memory_id order by ingest_seq) = 1) r on r.memory_id = q.memory_id
), b as (select *, unnest([128, 256, 512, 1024, 2048]) as budget from j),
f as (select *, greatest(1, floor((41 + sum(length(line) + 1) over (partition by budget order by rank rows unbounded preceding)) / 4)) <= budget as fits from b)
select budget, rank, memory_id, md5(line) as line_md5, false as truncated from f where fits""",
    "token_counts": f"""select doc_id, case when coalesce(text, '') = '' then 0 else greatest(1, floor(length(text) / 4)) end::bigint as n_estimated,
  {_simple("text")} as n_simple, md5(regexp_extract(text, '^(?:{sql.SPACE}*(?:{sql.WORD}+|{sql.MARK})){{0,50}}', 0)) as first_md5 from documents""",
    "memory_block": f"""with q as ({_v1_sql(_VALID, _BONUS, 5)}), r as (select * from memory_records_v1 qualify row_number() over (partition by memory_id order by ingest_seq) = 1)
select '[MEMORY]' || e'\\n' || string_agg('- ' || r.statement, e'\\n' order by q.rank) as block from q join r on r.memory_id = q.memory_id""",
}
