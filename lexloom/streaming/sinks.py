"""Writing streams so that a repeated batch changes nothing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import chunking, tables
from lexloom.session import shared_dir
from lexloom.sources import files


def _per_epoch(path: str, transform=lambda df: df):
    """foreachBatch writer: one folder per batch, overwritten when the batch runs again."""
    def write(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def start_updates(df: DataFrame, path: str, checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    """Each batch's changed rows as a folder below ``path``."""
    trigger = trigger or {"availableNow": True}
    return df.writeStream.outputMode(mode).foreachBatch(_per_epoch(path)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Newest row of each key over all batches."""
    from pyspark.sql.types import StructType
    fields = StructType(list(schema.fields)).add("epoch", "long")
    values = [f.name for f in schema.fields if f.name not in keys]
    rows = spark.read.schema(fields).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("__v")).select(*keys, "__v.*") if values else rows.select(*keys).distinct()


def run_available(df: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    """Runs a streaming DataFrame over everything that is there and returns the final rows."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    query = start_updates(df, path, shared_dir(spark, f"{name}-state"), mode)
    query.awaitTermination()
    return latest(spark, path, df.schema, keys)


# ------------------------------------------------------------------ feedback

FIRST = ["conversation_id", "query", "response", "sources"]
LAST = ["feedback_type", "feedback_text"]
KEYS = ["user_id", "message_id"]


def start_feedback(events: DataFrame, log: str, checkpoint: str, first: list[str] = FIRST, last: list[str] = LAST, order: list[str] | None = None, **trigger) -> StreamingQuery:
    """Last write wins per (user, message) without rewriting a target table.

    A batch is folded to one row per key and written to its own folder. Folding folded rows
    gives the same result, so readers fold the log again (``read_feedback``).
    """
    order = order or ["ts"]

    def fold(batch: DataFrame) -> DataFrame:
        d = batch.withColumn("__first_at", F.struct(*order)).withColumn("__last_at", F.struct(*order))
        lead = F.min_by(F.struct(*first, "__first_at"), F.col("__first_at"))
        tail = F.max_by(F.struct(*last, "__last_at"), F.col("__last_at"))
        return d.groupBy(*KEYS).agg(lead.alias("a"), tail.alias("b")).select(*KEYS, "a.*", "b.*")

    trigger = trigger or {"availableNow": True}
    return events.writeStream.foreachBatch(_per_epoch(log, fold)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_feedback(spark: SparkSession, log: str, first: list[str] = FIRST, last: list[str] = LAST) -> DataFrame:
    rows = spark.read.parquet(log)
    out = rows.groupBy(*KEYS).agg(F.min_by(F.struct(*first), "__first_at").alias("a"), F.max_by(F.struct(*last), "__last_at").alias("b"))
    return out.select(*KEYS, "a.*", "b.*")


# ------------------------------------------------------------------ file arrival

def start_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, pdf=None, size: int = 1000, overlap: int = 150, **trigger) -> StreamingQuery:
    """New files: pages, chunks and a status row each, in folders per batch below ``out``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arrivals = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def handle(batch: DataFrame, epoch: int) -> None:
        ok, rejected = files.split_supported(batch)
        pages = files.extract_pages(ok, pdf)
        pages.where(F.col("page_number").isNotNull()).write.mode("overwrite").parquet(f"{out}/pages/epoch={epoch}")
        stored = batch.sparkSession.read.schema(pages.schema).parquet(f"{out}/pages/epoch={epoch}")
        parts = chunking.recursive_chunks(stored.withColumnRenamed("path", "document_id"), ["document_id", "page_number"], "text", size, overlap)
        chunks = chunking.number_chunks(parts, "document_id", "page_number", "pos").drop("pos")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/epoch={epoch}")
        counts = batch.sparkSession.read.parquet(f"{out}/chunks/epoch={epoch}").groupBy(F.col("document_id").alias("path")).agg(F.count(F.lit(1)).alias("chunk_count"))
        status = ok.select("path").join(counts, "path", "left").select(
            "path", F.when(F.col("chunk_count").isNull(), "failed").otherwise("completed").alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            F.when(F.col("chunk_count").isNull(), "no text").alias("error_message"))
        status = status.unionByName(rejected.select("path", F.lit("failed").alias("status"), F.lit(0).cast("bigint").alias("chunk_count"), F.col("reason").alias("error_message")))
        status.write.mode("overwrite").parquet(f"{out}/status/epoch={epoch}")

    trigger = trigger or {"availableNow": True}
    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def folded(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch form: a target table after one folded batch."""
    return tables.merge_feedback(target, batch, KEYS, LAST)
