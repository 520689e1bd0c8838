"""Queries of the text operators, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomill.common import spread, table
from chronomill.llm import codedocs, encoding, leaks, splitting, twins


def _statements(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "memory_records").select(F.lit("memory_records").alias("record_table"), "id", "statement")
    v1 = table(spark, d, "memory_records_v1").select(F.lit("memory_records_v1").alias("record_table"), F.col("memory_id").alias("id"), "statement")
    return records.unionByName(v1)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return (
        twins.twins(_statements(spark, d)).where("keep_id <> copy_id").select("record_table", "keep_id", "copy_id").distinct()
    )


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct record once, with how many ids and rows say the same."""
    groups = twins.twins(_statements(spark, d)).groupBy("record_table", "keep_id")
    return groups.agg(F.count("*").alias("n_ids"), F.sum("n_rows").alias("n_rows"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return codedocs.found(spread(table(spark, d, "task_environments")))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return codedocs.pairs(spread(table(spark, d, "task_environments")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(spread(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))


def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the template of items, with their own or other numbers, units and names."""
    return leaks.templates(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))[0]


def p9_members(spark: SparkSession, d: str) -> DataFrame:
    """Items that share the templates of ``p9_templates``."""
    return leaks.templates(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))[1]


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.by_item(p9_found(spark, d), table(spark, d, "eval_items"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(spread(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece_no = 0").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_templates": p9_templates,
    "p9_members": p9_members,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}

_NAMES = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: true)"

ORACLES: dict[str, str] = {
    "p9_found": f"""
with d as (select doc_id, {_NAMES} as w from documents), i as (select item_id, {_NAMES} as w from eval_items),
dw as (select doc_id, array_to_string(w[k : k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
iw as (select distinct item_id, array_to_string(w[k : k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i))
select distinct doc_id, item_id from dw join iw using (g)""",
    "p9_items": f"""
with d as (select doc_id, {_NAMES} as w from documents), i as (select item_id, split, {_NAMES} as w from eval_items),
dw as (select doc_id, array_to_string(w[k : k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
iw as (select distinct item_id, array_to_string(w[k : k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
n as (select item_id, count(distinct doc_id) as n from dw join iw using (g) group by 1),
f as (select i.item_id, split, coalesce(n, 0) as n_docs from i left join n using (item_id))
select *, rank() over (partition by split order by n_docs desc)::int as rank from f""",
}
