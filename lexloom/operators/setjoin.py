"""Similar sets of two tables: prefix-filtered join on Jaccard similarity.

All elements stand in one order, rare ones first. Two sets that share o elements share one among
the first n - o + 1 of each, so only these prefixes are join keys and the commonest elements are
none. o depends on both sizes; sizes fall into classes a quarter apart, and every pair of
classes that can be similar at all has prefixes of its own. Pairs that meet are counted; what
they may share behind their last common prefix element bounds the overlap, and only pairs that
can still reach the threshold are compared whole.

The order comes from counts in BUCKETS hash buckets, so its size does not grow with the data;
any order gives the same pairs, a rarer one fewer candidates.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexloom.session import checkpoint

BUCKETS = 1 << 18
_STEP = 1.25  # sizes within a class


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)


def element_counts(sets: DataFrame) -> np.ndarray:
    """How often elements of each hash bucket occur; every task hands on one row per bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            values = batch.column("elements").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(_bucket(values), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])
    counts = np.zeros(BUCKETS, np.int64)
    found = sets.select("elements").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def rare_first(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """The sets with their elements in the common order."""
    shipped = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("elements")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            order = np.lexsort((values, shipped.value[_bucket(values)], row))
            ordered = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[order]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), ordered], names=["id", "size", "elements"])
    return sets.select("id", "size", "elements").mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, size int, elements array<bigint>")


def _with_size(sets: DataFrame) -> DataFrame:
    size = F.size("elements")
    return sets.where(F.col("elements").isNotNull() & (size > 0)).withColumn("size", size).withColumn("class", F.floor(F.log("size") / F.log(F.lit(_STEP))).cast("int"))


def _class_sizes(sets: DataFrame) -> list[tuple[int, int, int]]:
    """(class, smallest size, largest size): some hundred rows at most."""
    return [tuple(r) for r in sets.groupBy("class").agg(F.min("size"), F.max("size")).collect()]


def prefixes(sets: DataFrame, partners: DataFrame, threshold: float) -> DataFrame:
    """Join keys: (id, size, class, other, element, place) for every class of partners."""
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("least")) - 1e-9))
    cut = sets.join(F.broadcast(partners), "class").withColumn("n", (F.col("size") - need + 1).cast("int")).where("n > 0")
    return cut.select("id", "size", "class", "other", F.posexplode(F.slice("elements", F.lit(1), F.col("n"))).alias("place", "element")).withColumn("place", F.col("place") + 1)


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, shared, score) of all pairs with a Jaccard similarity of ``threshold`` or more.

    Both tables have id and elements (array<bigint>, distinct); null and empty sets have no
    partner. Ids should be unique. The score is not rounded.
    """
    spark = left.sparkSession
    left, right = checkpoint(_with_size(left), "sets"), _with_size(right)
    own = _class_sizes(left)
    low, high = min((s[1] for s in own), default=0), max((s[2] for s in own), default=0)
    right = checkpoint(right.where((F.col("size") >= F.lit(low * threshold)) & (F.col("size") * F.lit(threshold) <= high)), "sets")
    theirs = _class_sizes(right)
    met = [(a, b) for a in own for b in theirs if b[1] * threshold <= a[2] and a[1] * threshold <= b[2]]
    shape = "class int, other int, least int"
    of_left = spark.createDataFrame([(a[0], b[0], b[1]) for a, b in met], shape)
    of_right = spark.createDataFrame([(b[0], a[0], a[1]) for a, b in met], shape)
    counts = element_counts(right)
    ordered = [rare_first(s, counts) for s in (left, right)]
    ordered = [s.withColumn("class", F.floor(F.log("size") / F.log(F.lit(_STEP))).cast("int")) for s in ordered]
    keys = checkpoint(prefixes(ordered[0], of_left, threshold).selectExpr("id AS left_id", "size AS n", "class AS a", "other AS b", "element", "place AS i"), "prefixes")
    others = prefixes(ordered[1], of_right, threshold).selectExpr("id AS right_id", "size AS m", "other AS a", "class AS b", "element", "place AS j")
    counted = others.join(keys, ["element", "a", "b"]).groupBy("left_id", "right_id", "n", "m").agg(
        F.count(F.lit(1)).alias("met"), F.max("i").alias("i"), F.max("j").alias("j"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - 1e-9
    open_pairs = checkpoint(counted.where(F.col("met") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need).select("left_id", "right_id", "n", "m"), "pairs")
    whole = open_pairs.join(left.select(F.col("id").alias("left_id"), F.col("elements").alias("x")), "left_id") \
        .join(right.select(F.col("id").alias("right_id"), F.col("elements").alias("y")), "right_id")
    shared = whole.select("left_id", "right_id", "n", "m", F.size(F.array_intersect("x", "y")).alias("shared"))
    score = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    return shared.withColumn("score", score).where(F.col("score") >= threshold - 1e-12).select("left_id", "right_id", "shared", "score")
