"""Sorted runs: a table range-partitioned and sorted, so that neighbouring rows are neighbours whatever the skew.

A run is one partition. Runs are cut by rows, not by keys or clock, so a key with a third of all rows spreads over
as many runs as it needs. What an operator cannot tell from its run alone is at the run's borders: it leaves a few
rows for each run, which are settled afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

RUN_BYTES, MOST_RUNS = 32 << 20, 100_000


def n_runs(df: DataFrame, run_bytes: int = RUN_BYTES) -> int:
    """Number of runs by the size the planner expects; at least one for each core.

    At most ``MOST_RUNS``, as their borders are held by the driver; beyond that runs grow instead.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0
    return min(MOST_RUNS, max(df.sparkSession.sparkContext.defaultParallelism, -(-known // run_bytes)))


def in_runs(df: DataFrame, order: list[str], each: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, runs: int | None = None) -> DataFrame:
    """``each(run number, batches in order)`` on every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        yield from each(task.partitionId() if task else 0, batches)

    return df.repartitionByRange(runs or n_runs(df), *order).sortWithinPartitions(*order).mapInArrow(run, schema)
