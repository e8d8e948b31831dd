"""Order-dependent operators that survive a hot key.

A window function reads every row of a key in one task. Here a key is cut into ordered
buckets (``bucket`` grows with the order columns): windows run inside (key, bucket), one
aggregate row per bucket is combined across buckets, and the two are joined again. A key
holding a third of the table is spread over as many tasks as it has buckets. With
``bucket=None`` the plain window is used.

The order columns must be unique within a key. Null keys are a key of their own, and rows
whose order or bucket is null come first in ascending order, with and without buckets.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.session import checkpoint

_B = "__bucket"


def _join_buckets(rows: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (key, bucket) joined to the rows of its bucket, nulls matching nulls."""
    names = [*keys, _B]
    other = per_bucket.withColumnsRenamed({c: f"__join_{i}" for i, c in enumerate(names)})
    same = [F.col(c).eqNullSafe(F.col(f"__join_{i}")) for i, c in enumerate(names)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return rows.join(other, on).drop(*[f"__join_{i}" for i in range(len(names))])


def _ordering(order: list[str], descending: bool):
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1.

    Each task keeps its own best k rows before the shuffle (WindowGroupLimit), so a hot key
    moves k rows per task and no more.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                bucket: Column | None = None, descending: bool = False) -> DataFrame:
    """Sum of ``value`` up to and including the row."""
    by = _ordering(order, descending)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    cut = df.withColumn(_B, bucket)
    inner = Window.partitionBy(*keys, _B).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(*_ordering([_B], descending)).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*keys, _B).agg(F.sum(value).alias("__total"))
        .withColumn("__before", F.sum("__total").over(across)).drop("__total")
    )
    return (
        _join_buckets(cut.withColumn("__inner", F.sum(value).over(inner)), before, keys)
        .withColumn(out, F.coalesce(F.col("__inner"), F.lit(0)) + F.coalesce(F.col("__before"), F.lit(0)))
        .drop("__inner", "__before", _B)
    )


def row_index(df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column | None = None,
              start: int = 0, descending: bool = False) -> DataFrame:
    """Dense position of the row within its key, from ``start``."""
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*_ordering(order, descending))
        return df.withColumn(out, (F.row_number().over(w) + (start - 1)).cast("bigint"))
    out_df = running_sum(df, keys, order, F.lit(1).cast("bigint"), out, bucket, descending)
    return out_df.withColumn(out, F.col(out) + (start - 1))


def running_sum_by_range(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` up to and including the row, without buckets known beforehand.

    Rows are sorted by range of (key, order), with bounds that Spark draws from the rows, so a
    hot key fills many ranges; a range adds up its own rows and one sum per key and range is
    carried on. The result is based on a table on shared storage.
    """
    ranged = checkpoint(df.withColumn("__value", value).repartitionByRange(*keys, *order).withColumn(_B, F.spark_partition_id()), "ranges")
    across = Window.partitionBy(*keys).orderBy(_B)
    before = ranged.groupBy(*keys, _B).agg(F.sum("__value").alias("__total")).withColumn("__before", F.sum("__total").over(across) - F.col("__total")).drop("__total")
    inner = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = _join_buckets(ranged.withColumn("__inner", F.sum("__value").over(inner)), before, keys)
    return summed.withColumn(out, F.col("__before") + F.col("__inner")).drop("__before", "__inner", "__value", _B)


def row_index_by_range(df: DataFrame, keys: list[str], order: list[str], out: str, start: int = 0) -> DataFrame:
    """Dense position of the row within its key, in the same way."""
    numbered = running_sum_by_range(df, keys, order, F.lit(1).cast("bigint"), out)
    return numbered.withColumn(out, F.col(out) + (start - 1))


def carry(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
          bucket: Column | None = None, inclusive: bool = True, backward: bool = False) -> DataFrame:
    """Last non-null ``value`` at or before the row (``inclusive``) or strictly before it.

    ``backward=True`` takes the first non-null value at or after the row instead.
    """
    last = 0 if inclusive else -1
    by = _ordering(order, backward)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    cut = df.withColumn(_B, bucket).withColumn("__value", value)
    inner = Window.partitionBy(*keys, _B).orderBy(*by).rowsBetween(Window.unboundedPreceding, last)
    across = Window.partitionBy(*keys).orderBy(*_ordering([_B], backward)).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if backward else F.max_by
    # rows without a value have no place in the order, so a bucket without values gives null
    place = F.when(F.col("__value").isNotNull(), F.struct(*order))
    carried = (
        cut.groupBy(*keys, _B).agg(pick("__value", place).alias("__edge"))
        .withColumn("__carried", F.last("__edge", ignorenulls=True).over(across)).drop("__edge")
    )
    return (
        _join_buckets(cut.withColumn("__inner", F.last("__value", ignorenulls=True).over(inner)), carried, keys)
        .withColumn(out, F.coalesce("__inner", "__carried"))
        .drop("__inner", "__carried", "__value", _B)
    )


def previous_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str], out: str,
                 bucket: Column | None = None) -> DataFrame:
    """Struct of ``cols`` of the row before; null on the first."""
    return carry(df, keys, order, F.struct(*cols), out, bucket, inclusive=False)


def next_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str], out: str,
             bucket: Column | None = None) -> DataFrame:
    """Struct of ``cols`` of the row after; null on the last."""
    return carry(df, keys, order, F.struct(*cols), out, bucket, inclusive=False, backward=True)


def preceding_rows(df: DataFrame, keys: list[str], order: list[str], value: Column, n: int, out: str,
                   bucket: Column | None = None, width: int = 1024) -> DataFrame:
    """Array of the ``n`` rows before the row, oldest first.

    Rows are numbered, cut into blocks of ``width`` and the last n rows of a block are copied
    into the next one, so each block's frame is complete without its neighbour.
    """
    w_rows = (-n, -1)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*w_rows)
        return df.withColumn(out, F.collect_list(value).over(w))
    numbered = row_index(df, keys, order, "__pos", bucket)
    block = F.floor(F.col("__pos") / width)
    late = F.col("__pos") % width >= width - n
    halo = F.when(late, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("__block", F.explode(halo))
    w = Window.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(*w_rows)
    return (
        spread.withColumn(out, F.collect_list(value).over(w))
        .where(F.col("__block") == block).drop("__pos", "__block")
    )


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles per key.

    Equal values are counted first (partial aggregation), the counts are summed in value
    order range by range, whose bounds Spark draws from the values, and only the two rows around
    each percentile are aggregated: no task holds a key's values, however they are spread.
    ``width`` is no longer read.
    """
    grid = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(1))
    counts = base.where(F.col(value).isNotNull()).groupBy(*grid, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_sum_by_range(counts, grid, [value], F.col("__n"), "__upto")
    totals = counts.groupBy(*[F.col(c).alias(f"__key_{i}") for i, c in enumerate(grid)]).agg(F.sum("__n").alias("__rows"))
    on = F.lit(True)
    for i, c in enumerate(grid):
        on = on & F.col(c).eqNullSafe(F.col(f"__key_{i}"))
    placed = upto.join(totals, on)
    first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
    aggs = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("__rows") - 1)
        low, high = F.floor(at), F.ceil(at)
        def pick(p):
            return F.max(F.when((p >= first) & (p <= last), F.col(value).cast("double")))
        aggs.append((pick(low) + F.max(at - low) * (pick(high) - pick(low))).alias(name))
    out = placed.groupBy(*grid).agg(*aggs)
    return out if keys else out.drop("__all")
