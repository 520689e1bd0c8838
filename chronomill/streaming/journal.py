"""Structured Streaming over append-only journals: store state, orphan state and windowed counts.

A micro-batch is folded into the state by the same functions that take a whole journal at once. State tables
are written to the shared folder, one version per batch; a batch that is run again after a failure writes the
same version again, so states are exact across restarts. A table that is only added to holds in each version what the
batch added; of the others the last two versions are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronomill.common import cut, shared_folder
from chronomill.operators import references, store


def log_stream(spark: SparkSession, path: str, schema: T.StructType, form: str = "json", files_per_batch: int = 16) -> DataFrame:
    """An append-only log, a folder or a single file, as a stream of its files, oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        stream, path = stream.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return stream.load(path)


class FoldedState:
    """Versions of state tables in a folder; ``step`` makes the next version from the last and a batch."""

    def __init__(self, spark: SparkSession, step: Callable[[dict[str, DataFrame] | None, DataFrame], dict[str, DataFrame]], folder: str | None = None, added: tuple[str, ...] = ()) -> None:
        self.spark, self.step, self.added = spark, step, added
        self.folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def _path(self, path: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list[str]:
        fs, at = self._path(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    @property
    def version(self) -> int:
        """The last version in the folder, -1 without any; a folder that is given again is taken up where it was."""
        return max([int(n[1:]) for n in self._listed(self.folder) if n[:1] == "v" and n[1:].isdigit()], default=-1)

    def read(self, version: int | None = None) -> dict[str, DataFrame] | None:
        v = self.version if version is None else version
        if v < 0:
            return None
        names = self._listed(f"{self.folder}/v{v}")
        return {n: self.spark.read.parquet(*[f"{self.folder}/v{k}/{n}" for k in range(0 if n in self.added else v, v + 1)]) for n in names}

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        tables = self.step(self.read(batch_id - 1), batch)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}/{name}")
        for name in set(tables).difference(self.added) if batch_id > 1 else ():
            fs, at = self._path(f"{self.folder}/v{batch_id - 2}/{name}")
            fs.delete(at, True)

    def run(self, stream: DataFrame) -> dict[str, DataFrame] | None:
        """Take in everything that is there now, and give the state."""
        query = (
            stream.writeStream.foreachBatch(self.fold)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.read()


def store_state(spark: SparkSession, folder: str | None = None) -> FoldedState:
    """The legacy store from a stream of its writes."""

    def step(state: dict[str, DataFrame] | None, batch: DataFrame) -> dict[str, DataFrame]:
        return {"records": store.fold(state and state["records"], store.written(batch))}

    return FoldedState(spark, step, folder)


def orphan_state(spark: SparkSession, refs_of: Callable[[DataFrame], DataFrame], parents_of: Callable[[DataFrame], DataFrame], folder: str | None = None) -> FoldedState:
    """Pending orphans from a stream of rows that hold references and are themselves targets."""

    def step(state: dict[str, DataFrame] | None, batch: DataFrame) -> dict[str, DataFrame]:
        old = orphans_of(state) if state else None
        parents, moved = references.step(old, refs_of(batch), parents_of(batch))
        moved = cut(moved)
        return {"parents": parents, "pending": moved.where("status = 'pending'").select(*references.REF), "log": moved.where("status <> 'pending'")}

    return FoldedState(spark, step, folder, added=("log",))


def orphans_of(state: dict[str, DataFrame]) -> references.OrphanState:
    return references.OrphanState(state["parents"], state["pending"], state["log"])


def windowed(events: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per time window and key; events later than the watermark are dropped in append mode."""
    w = events.withWatermark(at, late) if events.isStreaming else events
    g = w.groupBy(F.window(at, width).alias("_w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("_w.start").alias("window_start"), *by, "n", "total")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and give the last result table it had."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: dict[str, int] = {}

    def keep(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/v{batch_id}")
        last["v"] = batch_id

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/v{last['v']}") if last else spark.createDataFrame([], stream.schema)
