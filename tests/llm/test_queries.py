from __future__ import annotations

import duckdb
import pytest

from chronomill.llm import queries as Q

COLUMNS = {
    "p1_found": {"record_table", "keep_id", "copy_id"},
    "p4_found": {"task_id", "side", "path", "function_name"},
    "p8_ids": {"doc_id", "ids"},
    "p9_found": {"doc_id", "item_id"},
    "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    rows = df.collect()
    assert set(df.columns) == COLUMNS.get(name, set(df.columns)) and rows


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "eval_items"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = Q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rel = c.execute(Q.ORACLES[name])
    at = [x[0] for x in rel.description]
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(tuple(r[at.index(x)] for x in cols) for r in rel.fetchall())
