"""Row-wise helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column whose value is worked out once per row.

    Catalyst copies a projected expression into every filter it pushes down or infers (an
    explode infers two). A one-element generator is a boundary for that, so a costly split
    or regex runs once.
    """
    return df.withColumn(name, F.explode(F.array(value)))
