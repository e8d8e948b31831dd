"""Catalogue of this folder: names, queries, SQL, and how queries read their tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BATCH_ROWS = "2000"


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable in the workers and keeps Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame, and its SQL where there is one."""
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep
