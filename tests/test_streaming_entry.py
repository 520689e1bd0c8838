from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronomill import plans
from chronomill.operators import references, store
from chronomill.streaming import journal
from tests.test_store import W, sequential, writes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings memory_records memory_records_v1 evidence episode_events task_environments eval_items".split()


def test_store_stream_over_several_batches(spark, tmp_path):
    rows = writes(7)
    for k in range(4):
        spark.createDataFrame(rows[k * 30 : (k + 1) * 30], W).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    stream = journal.log_stream(spark, str(tmp_path / "log"), spark.createDataFrame([], W).schema, files_per_batch=1)
    state = journal.store_state(spark)
    got = state.run(stream)["records"]
    assert state.version == 3 and {r.id: (r.valid_to, r.status) for r in got.collect()} == sequential(rows)
    # More of the log arrives, and another process takes the folder up where it was.
    more = [(200 + r[0], *r[1:]) for r in writes(9)[:40]]
    spark.createDataFrame(more, W).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    again = journal.store_state(spark, state.folder)
    got = again.run(stream)["records"]
    assert again.version == 4 and {r.id: (r.valid_to, r.status) for r in got.collect()} == sequential(rows + more)


def test_orphan_stream_is_the_batch(spark, tmp_path):
    rows = writes(8)
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], W).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    refs = lambda b: references.scalar_refs(b, "supersedes", "record", "supersedes", "ingest_seq", "created_at")
    parents = lambda b: references.parent_rows(b, "record", "id", "created_at")
    stream = journal.log_stream(spark, str(tmp_path / "log"), spark.createDataFrame([], W).schema, files_per_batch=1)
    s = journal.orphan_state(spark, refs, parents, str(tmp_path / "state")).run(stream)
    all_ = spark.createDataFrame(rows, W)
    want = references.advance(None, refs(all_), parents(all_)).orphans()
    pick = lambda d: sorted(map(tuple, d.select("ingest_seq", "ref_key").collect()))
    # The last two versions of what is replaced, every version of what is only added to.
    assert [sorted(p.name for p in tmp.iterdir()) for tmp in (tmp_path / "state" / f"v{k}" for k in range(3))] == [["log"], ["log", "parents", "pending"], ["log", "parents", "pending"]]
    assert pick(journal.orphans_of(s).orphans()) == pick(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.oracles()) <= set(plans.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_against_sql(spark, data, db, name):
    df = plans.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.execute(plans.oracles()[name])
    at = [x[0] for x in rel.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracles())))
def test_query_without_sql_runs(spark, data, name):
    plans.queries()[name](spark, data).collect()


@pytest.mark.parametrize("name", ["store_propagate", "p2_found", "p3_found", "p5_found", "p6_found", "p7_found"])
def test_empty_tables(spark, data, tmp_path, name):
    for t in ("memory_records", "memory_records_v1", "evidence", "episode_events", "task_environments", "documents"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert plans.queries()[name](spark, str(tmp_path)).count() == 0
    assert store.deliveries(spark.read.parquet(f"{tmp_path}/memory_records_v1.parquet")).count() == 0
