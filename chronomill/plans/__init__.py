"""Named queries of the core, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronomill.plans import evaluation, ledgers, matching, retrieval, sources, store, streams, texts

MODULES = (ledgers, store, retrieval, evaluation, matching, texts, sources, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve_superseded(spark, sf_dir)
