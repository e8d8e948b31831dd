"""Documents into section trees, end to end."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lexloom.operators import tree as R
from lexloom.session import checkpoint, small


def build_index(pages: DataFrame, regenerate: Callable[[DataFrame], DataFrame] = R.headings, keep_text: bool = True,
                make_summary_client=None, summary_template: str = "{title}\n{text}") -> DataFrame:
    """Numbered nodes of every document. pages: document_id, page_number, text, token_count.

    Contents pages are found and read, page numbers shifted to physical pages, titles
    checked; good tables are kept, fair ones repaired, poor or missing ones rebuilt from the
    text by ``regenerate``. Large sections are split with the same function.
    """
    pages = checkpoint(pages, "pages")
    bounds = pages.groupBy(R.DOC).agg(F.lit(1).alias("first_page"), F.max("page_number").alias("last_page"), F.max("page_number").alias("n_pages"))
    # a few pages a document, so texts are not shuffled to find them
    marked = checkpoint(R.toc_pages(pages, R.looks_like_toc(F.col("text"))), "toc-pages")
    toc_text = pages.join(small(marked), [R.DOC, "page_number"], "left_semi")
    toc = checkpoint(R.toc_rows(toc_text), "toc-rows")
    last = marked.groupBy(R.DOC).agg(F.max("page_number").alias("last_toc_page"))
    body = pages.join(small(last), R.DOC).where(F.col("page_number") > F.col("last_toc_page"))
    found = regenerate(body.select(*pages.columns))
    placed = R.add_physical_indices(toc, found.select(R.DOC, "title", "physical_index"), last)
    without = pages.select(R.DOC).distinct().join(toc.select(R.DOC).distinct(), R.DOC, "left_anti")
    fresh = checkpoint(regenerate(pages), "fresh")  # used twice
    rows = placed.select(R.DOC, "pos", "structure", "title", F.col("physical_index").cast("int")) \
        .unionByName(fresh.join(without, R.DOC, "left_semi").select(R.DOC, "pos", "structure", "title", F.col("physical_index").cast("int")))
    valid = R.valid_rows(rows, bounds.select(R.DOC, "n_pages"))
    verified = checkpoint(R.verify_rows(valid, pages).select(*rows.columns, "is_correct"), "toc-verified")
    repaired = R.repair_rows(verified, pages, bounds.select(R.DOC, "first_page", "last_page"))
    again = R.valid_rows(fresh.select(R.DOC, "pos", "structure", "title", F.col("physical_index").cast("int")), bounds.select(R.DOC, "n_pages"))
    chosen = R.add_preface(R.choose_by_accuracy(verified, repaired, again, toc))
    text_of = pages.select(R.DOC, F.col("page_number").alias("physical_index"), F.col("text").alias("__t"))
    # a title on a page without text starts no page, and stays
    starts = F.when(F.col("__t").isNull(), F.lit("no")).otherwise(R.starts_page(F.col("title"), F.col("__t")))
    flagged = chosen.join(text_of, [R.DOC, "physical_index"], "left").withColumn("appear_start", starts).drop("__t")
    nodes = R.build_tree(flagged, bounds.select(R.DOC, "last_page"))

    def contents(big: DataFrame, all_pages: DataFrame) -> DataFrame:
        inside = big.select(R.DOC, F.col("path").alias("parent_path"), F.explode(F.sequence("start_index", "end_index")).alias("page_number"))
        part = inside.join(all_pages, [R.DOC, "page_number"]).withColumn(R.DOC, F.struct(R.DOC, "parent_path"))
        rows = regenerate(part.select(R.DOC, "page_number", "text"))
        return rows.select(F.col(f"{R.DOC}.{R.DOC}").alias(R.DOC), F.col(f"{R.DOC}.parent_path").alias("parent_path"), "pos", "structure", "title", "physical_index", "appear_start")

    numbered = R.number_nodes(R.split_large_nodes(nodes, pages, contents))
    out = R.node_texts(numbered, pages)
    if make_summary_client is not None:
        out = R.summarise(out, make_summary_client, summary_template)
    return out if keep_text else out.drop("text")
