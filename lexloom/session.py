"""Session settings and shared scratch space."""
from __future__ import annotations

import contextvars
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_on_the_way: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_on_the_way", default=None)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job of this package relies on; cluster sizing stays with the cluster."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # stream state on local disk with changelogs, not on the heap
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers of the session, wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "lexloom")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(app)
    return spark


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared checkpoint folder.

    Where a local session names none (tests, a laptop) one is made under the temporary
    folder. On a cluster that folder would differ from machine to machine, so it must be named.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(_CHECKPOINT_DIR)
    if not root:
        if not is_local(spark.sparkContext.master):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all machines of the cluster share")
        root = _local_dir()
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def is_local(master: str) -> bool:
    """True for a master whose executors are threads of this process."""
    return master == "local" or master.startswith("local[")


def checkpoint(df: DataFrame, name: str = "step") -> DataFrame:
    """The DataFrame written to and read back from shared storage.

    Lost executors then cost a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if (passing := _on_the_way.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], tuple[DataFrame, ...]], *names: str) -> list[DataFrame]:
    """What ``build()`` returns, each as a checkpoint of its name; the checkpoints written on the way there are deleted.

    For steps whose results are small beside what they pass through. Nothing but these results may
    still read what ``build`` wrote. Calls may be nested.
    """
    passed: list[str] = []
    outer = _on_the_way.set(passed)
    try:
        results = build()
    finally:
        _on_the_way.reset(outer)
    kept = [checkpoint(df, name) for df, name in zip(results, names, strict=True)]
    for path in passed:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return kept


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when the DataFrame has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Marked for broadcast when it is shown to have few rows, unchanged otherwise.

    For rows of a few dozen bytes, so the bound keeps the copy below some 100 MB.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(scan: DataFrame) -> DataFrame:
    """A table scan with fewer splits than task slots, dealt out over all slots.

    For row-wise work heavier than a shuffle of the row. Large tables have more splits than
    slots and pass unchanged. Only for plain scans: counting splits runs nothing there.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan
