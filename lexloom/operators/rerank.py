"""Second-stage ranking, and literal search inside documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom import vocab
from lexloom.functions import scoring, text as T
from lexloom.operators.ordered import top_k


def rerank_terms(question: Column) -> Column:
    """ASCII words of the question longer than two characters without stop words, repeats kept."""
    words = F.split(F.lower(question), r"[^A-Za-z0-9_]+", -1)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*vocab.RERANK_STOP_WORDS))


def term_score(terms: Column, body: Column) -> Column:
    """Whole-word occurrences of the terms over the square root of the text length.

    Terms are plain words, so an occurrence between word boundaries is a word of the text.
    """
    words = F.split(body, r"[^A-Za-z0-9_]+", -1)

    def count(parts):
        hits = F.filter(parts["words"], lambda w: F.array_contains(parts["terms"], w))
        per_term = lambda found: F.aggregate(parts["terms"], F.lit(0), lambda n, t: n + F.size(F.filter(found, lambda w: w == t)))
        return T.let(hits, per_term)

    total = T.let(F.struct(words.alias("words"), terms.alias("terms")), count)
    return F.coalesce(F.try_divide(total, F.sqrt(F.length(body))), F.lit(0.0))


def keyword_rerank(hits: DataFrame, k: int = 5) -> DataFrame:
    """Best k per query by term score; ties keep the order they came in.

    hits: query_id, question, title, section_path, content, original_rank.
    """
    body = F.lower(F.concat("title", F.lit(" "), "section_path", F.lit(" "), "content"))
    scored = hits.withColumn("score", F.round(term_score(rerank_terms(F.col("question")), body), 9))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("original_rank")], k)


def rerank_or_pass(hits: DataFrame, model_score: str, k: int = 5, min_score: float = 0.3) -> DataFrame:
    """Queries with at most k hits keep their order and get 1, 0.9, 0.8 …; the others are
    ranked by the model score, at least ``min_score``, best k.

    Hits per query are bounded by the retrieval before, so the count window is too.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    few = F.col("__n") <= k
    scored = hits.withColumn("__n", n).withColumn("score", F.when(few, scoring.rank_decay(F.col("original_rank"))).otherwise(F.col(model_score)))
    kept = scored.where(few | (F.col("score") >= min_score)).drop("__n")
    return top_k(kept, ["query_id"], [F.col("score").desc(), F.col("original_rank")], k)


def model_rerank(hits: DataFrame, raw_score: str, first: int = 50, k: int = 10) -> DataFrame:
    """Best k of the first ``first`` hits by a model's 0-10 score; a missing score counts 5.

    Queries whose call failed for every hit keep the original order.
    """
    pool = hits.where(F.col("original_rank") <= first)
    ok = F.max(F.col(raw_score).isNotNull()).over(Window.partitionBy("query_id"))
    score = F.when(ok, F.coalesce(F.col(raw_score), F.lit(5.0)) / 10.0).otherwise(F.lit(0.0))
    return top_k(pool.withColumn("score", score), ["query_id"], [F.col("score").desc(), F.col("original_rank")], k)


def find_in_documents(chunks: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """Chunks holding the text (case-insensitive; % and _ are wildcards), first ``limit`` per
    document by page, pages unknown last, then chunk. A top-k report, hence the limit."""
    hits = chunks.where(F.col("text").ilike(f"%{needle}%"))
    return top_k(hits, ["document_id"], [F.col("page_number").asc_nulls_last(), F.col("chunk_index").asc()], limit)


def sources_per_document(hits: DataFrame, per_document: int, overall: int = 5) -> DataFrame:
    """At most ``per_document`` hits of a document and ``overall`` of a query, in arrival order.

    hits: query_id, document_id, document_pos, pos.
    """
    inner = top_k(hits, ["query_id", "document_id"], [F.col("pos")], per_document, "document_rank")
    return top_k(inner, ["query_id"], [F.col("document_pos"), F.col("document_rank")], overall)


def best_document(results: DataFrame) -> DataFrame:
    """One result per query: highest confidence, then most sources, then first to arrive.

    results: query_id, document_id, confidence, n_sources, pos.
    """
    level = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    return top_k(results, ["query_id"], [level.desc(), F.col("n_sources").desc(), F.col("pos")], 1).drop("rank")
