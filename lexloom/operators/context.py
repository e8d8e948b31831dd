"""Hits into prompt context and source panels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import text as T
from lexloom.operators.ordered import top_k

SEPARATOR = "\n\n" + "=" * 80 + "\n\n"


def source_block(rank: Column, path: Column, start: Column, end: Column, content: Column, summary: Column | None = None) -> Column:
    """``[n] path (Pages a-b)``, an optional summary, the content."""
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] "), path, F.lit(" (Pages "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))
    middle = F.lit("") if summary is None else F.coalesce(F.concat(F.lit("\nSummary: "), F.nullif(summary, F.lit("")), F.lit("\n")), F.lit(""))
    return F.concat(head, middle, F.lit("\n"), F.coalesce(F.nullif(content, F.lit("")), F.lit("Content not available.")))


def join_ordered(df: DataFrame, keys: list[str], order: str, text: str, separator: str, out: str, per_key: int) -> DataFrame:
    """One text per key: the first ``per_key`` texts by order, joined.

    The bound is the size of the context being built, so a group never outgrows it.
    """
    best = top_k(df, keys, [F.col(order)], per_key, "__n")
    rows = F.array_sort(F.collect_list(F.struct(F.col("__n"), F.col(text).alias("__t"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda s: s["__t"]), separator).alias(out))


def context_blocks(hits: DataFrame, k: int = 5) -> DataFrame:
    """Context text per query. hits: query_id, rank, section_path, page_start, page_end, content, summary."""
    block = source_block(F.col("rank"), F.col("section_path"), F.col("page_start"), F.col("page_end"), F.col("content"), F.col("summary"))
    return join_ordered(hits.withColumn("__block", block), ["query_id"], "rank", "__block", SEPARATOR, "context", k)


def tiered_sources(hits: DataFrame, k: int, top: int = 5) -> DataFrame:
    """Sources of a query by similarity: tier 'top' for the first five, 'other' after, grouped
    by file in first-seen order. Columns query_id, tier, file_name, file_pos, n_sources, best.

    ``k`` is the size of a result list, which bounds the windows over one query.
    """
    ranked = top_k(hits, ["query_id"], [F.col("similarity").desc(), F.col("pos")], k)
    tier = F.when(F.col("rank") <= top, "top").otherwise("other")
    files = ranked.withColumn("tier", tier).groupBy("query_id", "tier", "file_name").agg(
        F.min("rank").alias("__first"), F.count(F.lit(1)).alias("n_sources"), F.max("similarity").alias("best"))
    w = Window.partitionBy("query_id", "tier").orderBy("__first")
    return files.withColumn("file_pos", F.row_number().over(w)).drop("__first")


def display_rows(hits: DataFrame, limit: int = 500) -> DataFrame:
    """Sources as shown beside an answer: index from 1 and the first characters of the content."""
    return hits.withColumn("index", F.col("rank")).withColumn("content", T.preview(F.col("content"), limit, ellipsis=False))


def attribute_documents(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources with the document that owns the node; node ids repeat across trees, so the
    document is part of the key."""
    return sources.join(nodes.select("document_id", "node_id", "file_name"), ["document_id", "node_id"])
