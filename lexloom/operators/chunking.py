"""Texts into chunks: fixed windows, recursive splitting, semantic breaks, section titles."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexloom import vocab
from lexloom.functions import text as T
from lexloom.functions import vectors as V
from lexloom.operators import ordered
from lexloom.session import checkpoint


def fixed_chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """One row per window of ``size`` characters, ``overlap`` shared with the one before.

    The last window is the first that reaches the end. Adds chunk_index (from 0), start, content.
    """
    step = size - overlap
    length = F.length(text)
    last = F.greatest(F.ceil((length - overlap) / step) - 1, F.lit(0))
    out = df.where(length > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    start = F.col("chunk_index") * step
    return out.withColumn("start", start).withColumn("content", F.substring(F.col(text), (start + 1).cast("int"), F.lit(size)))


def split_recursive(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of at most ``size`` characters cut at the coarsest separator that works.

    A separator stays at the front of the piece it opens; neighbouring chunks share whole
    pieces of up to ``overlap`` characters.
    """
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1:]
    pieces = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    chunks: list[str] = []
    run: list[str] = []
    for piece in pieces:
        if len(piece) < size or not finer:
            if len(piece) < size:
                run.append(piece)
            else:
                chunks += _pack(run, size, overlap) + [piece]
                run = []
        else:
            chunks += _pack(run, size, overlap) + split_recursive(piece, size, overlap, finer)
            run = []
    return chunks + _pack(run, size, overlap)


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    first, held = 0, 0  # pieces[first:i] make up the open chunk of ``held`` characters
    for i, piece in enumerate(pieces):
        if held + len(piece) > size and first < i:
            out.append("".join(pieces[first:i]).strip())
            while held > overlap or (held > 0 and held + len(piece) > size):
                held -= len(pieces[first])
                first += 1
        held += len(piece)
    if first < len(pieces):
        out.append("".join(pieces[first:]).strip())
    return [c for c in out if c]


def recursive_chunks(pages: DataFrame, keys: list[str], text: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """keys, pos (from 0 within the row), content. One row in, its chunks out; no shuffle."""
    seps = vocab.SPLIT_SEPARATORS
    source = pages.select(*keys, text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name != text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (*key, pos, chunk)
                for *key, body in pdf.itertuples(index=False)
                if body
                for pos, chunk in enumerate(split_recursive(body, size, overlap, seps))
            ]
            yield pd.DataFrame(rows, columns=[*keys, "pos", "content"])

    return source.mapInPandas(run, f"{schema}, pos bigint, content string")


def number_chunks(chunks: DataFrame, document: str, page: str, pos: str, pages_per_bucket: int = 256) -> DataFrame:
    """chunk_index running over all pages of a document, from 0."""
    return ordered.row_index(chunks, [document], [page, pos], "chunk_index", F.floor(F.col(page) / pages_per_bucket))


def carry_section_titles(elements: DataFrame, document: str, order: list[str], is_title: Column, content: str, bucket: Column | None = None) -> DataFrame:
    """section_title: the latest title at or before the element."""
    return ordered.carry(elements, [document], order, F.when(is_title, F.col(content)), "section_title", bucket)


def semantic_breaks(sentences: DataFrame, document: str, order: str, vector: str, share: float = 0.9, bucket: Column | None = None) -> DataFrame:
    """segment: grows by one where the distance to the sentence before exceeds the
    document's ``share`` percentile of such distances."""
    prev = ordered.previous_row(sentences, [document], [order], [vector], "__prev", bucket)
    dist = prev.withColumn("distance", F.when(F.col("__prev").isNotNull(), F.round(1 - V.cosine(F.col(vector), F.col(f"__prev.{vector}")), 9))).drop("__prev")
    cut = ordered.percentiles(dist, [document], "distance", {"__cut": share})
    marked = dist.join(cut, document, "left").withColumn("is_break", F.coalesce(F.col("distance") > F.col("__cut"), F.lit(False)))
    return ordered.running_sum(marked, [document], [order], F.col("is_break").cast("bigint"), "segment", bucket).drop("__cut")


def with_context_header(chunks: DataFrame, title: str, content: str, section: Column | None = None) -> DataFrame:
    """content_with_context: breadcrumb header, blank line, content."""
    found = T.legal_structure(F.col(content))
    header = T.context_header(F.col(title), found["article_number"], section if section is not None else found["clause_number"])
    return chunks.withColumn("content_with_context", F.concat(header, F.lit("\n\n"), F.col(content)))


def pages_of_groups(pages: DataFrame, document: str, page: str, tokens: str, max_tokens: int = 20000, overlap: int = 1,
                    pages_per_bucket: int = 256) -> DataFrame:
    """document, group_no, page: pages packed greedily up to a token budget.

    A group starts with the ``overlap`` pages before it; the budget is
    ceil((total / parts + max) / 2) for parts = ceil(total / max), and everything is one
    group when it fits. Where a group ends depends on where it starts, so each page first
    finds the page that would end a group starting with it (one merge over running token
    sums). The starts really used are then reached from the first page by doubling the
    jump, which takes log2(groups) rounds whatever the size of a document.
    """
    b = F.floor(F.col("__i") / pages_per_bucket)
    base = ordered.row_index(pages.select(document, page, F.col(tokens).cast("bigint").alias("__t")), [document], [page], "__i",
                             F.floor(F.col(page) / pages_per_bucket))
    sums = ordered.running_sum(base, [document], ["__i"], F.col("__t"), "__sum", b)
    total = base.groupBy(document).agg(F.sum("__t").alias("__total"), F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.col("__total") / max_tokens)
    budget = F.when(F.col("__total") <= max_tokens, F.col("__total")).otherwise(F.ceil((F.col("__total") / parts + max_tokens) / 2))
    sums = sums.join(total.withColumn("__budget", budget), document)
    sums = checkpoint(sums, "page-sums")
    # a group whose own first page is i holds pages from max(i - overlap, 0); it ends before the
    # first page j > i with sum(j) > sum(before its first page) + budget
    lead = sums.select(document, (F.col("__i") + overlap).alias("__i"), (F.col("__sum") - F.col("__t")).alias("__lead"))
    starts = sums.join(lead, [document, "__i"], "left").withColumn("__limit", F.coalesce("__lead", F.lit(0)) + F.col("__budget"))
    # merge probes and sums by value: the answer is the first row above the limit
    rows = sums.select(document, F.col("__sum").alias("__v"), F.lit(0).alias("__kind"), "__i", F.col("__i").alias("__at"))
    probes = starts.select(document, F.col("__limit").alias("__v"), F.lit(1).alias("__kind"), "__i", F.lit(None).cast("bigint").alias("__at"))
    merged = ordered.carry(rows.unionByName(probes), [document], ["__v", "__kind", "__i"], F.col("__at"), "__next",
                           F.floor(F.col("__v") / (max_tokens * 16)), backward=True)
    jump = (
        merged.where((F.col("__kind") == 1) & F.col("__next").isNotNull())
        .select(document, F.col("__i").alias("__from"), F.greatest("__next", F.col("__i") + 1).alias("__to"))
    )
    jump = checkpoint(jump, "page-jumps")
    used = sums.where(F.col("__i") == 0).select(document, F.col("__i").alias("__from"))
    while True:
        reached = used.join(jump, [document, "__from"]).select(document, F.col("__to").alias("__from"))
        grown = checkpoint(used.unionByName(reached).distinct(), "page-starts")
        onward = jump.select(document, F.col("__from").alias("__to"), F.col("__to").alias("__end"))
        doubled = jump.join(onward, [document, "__to"]).select(document, "__from", F.col("__end").alias("__to"))
        if reached.join(used, [document, "__from"], "left_anti").isEmpty():
            break
        used, jump = grown, checkpoint(doubled, "page-jumps")
    groups = ordered.row_index(used, [document], ["__from"], "group_no", F.floor(F.col("__from") / pages_per_bucket))
    placed = sums.join(groups.withColumnRenamed("__from", "__i"), [document, "__i"], "left")
    placed = ordered.carry(placed, [document], ["__i"], F.col("group_no"), "__own", b)
    own = placed.select(document, page, F.col("__own").alias("group_no"))
    # the pages just before a start also belong to the group it opens
    shared = placed.where(F.col("group_no") > 0).select(
        document, F.explode(F.sequence(F.greatest(F.col("__i") - overlap, F.lit(0)), F.col("__i") - 1)).alias("__i"), "group_no") \
        if overlap > 0 else None
    if shared is None:
        return own
    return own.unionByName(shared.join(sums.select(document, "__i", page), [document, "__i"]).select(document, page, "group_no"))


def group_texts(groups: DataFrame, pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """document, group_no, text: the tagged pages of each packed group, as large as the token budget."""
    rows = groups.join(pages.select(document, page, T.labelled_page(F.col(page), F.col(text)).alias("__t")), [document, page])
    return rows.groupBy(document, "group_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "__t"))), lambda s: s["__t"]), "").alias("text"))
