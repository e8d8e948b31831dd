"""Writing chunks, results and reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexloom.functions import text as T
from lexloom.functions import vectors as V


def chunk_rows(chunks: DataFrame, vector: str = "embedding", buckets: int = 256) -> DataFrame:
    """Chunks as stored: one vector column per length, search tokens, a bucket to partition by.

    The bucket hashes document and chunk, so one large document is spread over all of them.
    """
    return (
        chunks.withColumn("embedding_local", V.vector_by_length(F.col(vector), 384))
        .withColumn("embedding_openai", V.vector_by_length(F.col(vector), 1536))
        .withColumn("tokens", T.tokens(F.col("content")))
        .withColumn("bucket", F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(buckets)).cast("int"))
        .drop(vector)
    )


def append_chunks(chunks: DataFrame, path: str, vector: str = "embedding", buckets: int = 256) -> None:
    chunk_rows(chunks, vector, buckets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.json(path)


def comparison_rows(results: DataFrame, configurations: list[str]) -> DataFrame:
    """One row per question, five columns per configuration, formatted for the CSV report.

    The configurations are named up front, so the pivot needs no extra pass.
    """
    shown = F.substring(F.replace(F.coalesce("response", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 500)
    formatted = results.select(
        "id", "query", "category", "difficulty", "configuration", F.col("passed").cast("string").alias("passed"),
        F.format_string("%.0f%%", F.round(F.col("accuracy") * 100, 0)).alias("accuracy"), F.col("duration").cast("string").alias("duration_ms"),
        F.format_string("%.5f", "cost").alias("cost_usd"), shown.alias("answer"))
    fields = ["passed", "accuracy", "duration_ms", "cost_usd", "answer"]
    return formatted.groupBy("id", "query", "category", "difficulty").pivot("configuration", configurations).agg(*[F.first(f).alias(f) for f in fields])


def write_comparison_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
