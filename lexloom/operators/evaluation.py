"""Answers and retrieval against expectations: per-question checks and grouped reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import citations as C, text as T
from lexloom.operators.ordered import top_k

# ------------------------------------------------------------------ per answer


def _lower_hits(words: Column, low: Column) -> Column:
    return F.filter(words, lambda w: low.contains(F.lower(w)))


def keyword_check(answer: Column, expected: Column) -> Column:
    """Struct found, missing, accuracy. A keyword may hold alternatives split by ';'; none expected = 1."""
    def check(pair):
        low = pair["low"]
        def hit(k):
            return F.exists(F.split(k, ";"), lambda a: low.contains(F.lower(T.trim_ws(a))))
        found = F.filter(pair["words"], hit)
        return F.struct(found.alias("found"), F.filter(pair["words"], lambda k: ~hit(k)).alias("missing"),
                        F.coalesce(F.try_divide(F.size(found), F.size(pair["words"])), F.lit(1.0)).alias("accuracy"))
    words = F.coalesce(expected, F.array().cast("array<string>"))
    return T.let(F.struct(F.lower(answer).alias("low"), words.alias("words")), check)


def article_match(answer: Column, expected: Column) -> Column:
    """Any expected article is mentioned; true when none is expected."""
    low = F.lower(answer)
    return (F.coalesce(F.size(expected), F.lit(0)) == 0) | F.coalesce(F.exists(expected, lambda a: low.contains(F.lower(a))), F.lit(False))


def passes(accuracy: Column, expected: Column, at_least: float = 0.5) -> Column:
    """Accuracy reached, or nothing to find."""
    return (accuracy >= at_least) | (F.coalesce(F.size(expected), F.lit(0)) == 0)


def answered(answer: Column) -> Column:
    """Longer than 50 characters and not an apology."""
    return (F.length(answer) > 50) & ~F.lower(answer).contains("sorry")


def evaluate(rows: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """All measures of an answer with its sources, and weighted scores.

    rows: response, sources array<struct<section_path, content>>, must_contain, should_contain,
    must_not_contain, expected_articles, expected_sections, expected_keywords (string arrays).
    The inline-citation flag looks at each paragraph on its own.
    """
    low = F.lower("response")
    n_sources = F.size("sources")
    d = rows.withColumn("__low", low).withColumn("__src", F.lower(F.array_join(F.transform(
        "sources", lambda s: F.concat_ws(" ", F.coalesce(s["section_path"], F.lit("")), F.coalesce(s["content"], F.lit("")))), " ")))
    d = d.withColumns({
        "must_hits": _lower_hits(F.col("must_contain"), F.col("__low")),
        "should_hits": _lower_hits(F.col("should_contain"), F.col("__low")),
        "must_not_hits": _lower_hits(F.col("must_not_contain"), F.col("__low")),
        "article_hits": _lower_hits(F.col("expected_articles"), F.col("__src")),
        "section_hits": _lower_hits(F.col("expected_sections"), F.col("__src")),
        "keyword_hits": _lower_hits(F.col("expected_keywords"), F.col("__low")),
        "__used": F.size(F.array_distinct(F.regexp_extract_all("response", F.lit(r"\[(\d+)\]"), F.lit(1)))),
        "__paras": F.filter(F.split("response", "\n\n", -1), lambda p: T.trim_ws(p) != ""),
    })
    cited_paras = F.size(F.filter("__paras", lambda p: p.rlike(r"\[\d+\]")))
    d = d.withColumn("inline_citations", (cited_paras > 1) | ((F.size("__paras") == 1) & (F.col("__used") > 0)))
    def size(c):
        return F.size(c)
    ret, gen, cit = weights["retrieval"], weights["generation"], weights["citation"]
    spare = F.greatest(F.lit(0), n_sources - size("article_hits") - size("section_hits"))
    retrieval = size("article_hits") * ret["correct_article_retrieved"] + size("section_hits") * ret["correct_section_retrieved"] + spare * ret["partial_match"]
    must = F.when(size("must_hits") == size("must_contain"), F.lit(gen["must_contain_all"])).otherwise(size("must_hits") * gen["must_contain_partial"])
    generation = must + size("should_hits") * gen["should_contain_bonus"] + size("must_not_hits") * gen["hallucination"]
    citation = F.when(F.col("inline_citations"), F.lit(cit["correct_inline_citation"])).otherwise(F.lit(0.0)) \
        + F.col("__used") * cit["correct_source_cited"] + (n_sources - F.col("__used")) * cit["missing_citation"]
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(empty)
    d = d.withColumns({
        "retrieval_precision": share(size("article_hits"), n_sources, F.lit(0.0)),
        "retrieval_recall": share(size("article_hits"), size("expected_articles"), F.when(n_sources > 0, 1.0).otherwise(0.0)),
        "keyword_accuracy": share(size("keyword_hits"), size("expected_keywords"), F.lit(1.0)),
        "citation_count": F.col("__used"),
        "citation_accuracy": share(F.least(F.col("__used"), n_sources), n_sources, F.lit(0.0)),
        "retrieval_score": retrieval, "generation_score": generation, "citation_score": citation,
    })
    # citations present but not spread through the text
    d = d.withColumn("placement_problem", ~F.col("inline_citations") & (F.col("__used") > 0))
    return d.withColumn("total_score", F.col("retrieval_score") + F.col("generation_score") + F.col("citation_score")).drop("__low", "__src", "__used", "__paras")


def document_recall(expected: Column, retrieved: Column) -> Column:
    """Share of expected names that contain, or are contained in, a retrieved name."""
    def norm(a):
        return F.transform(a, lambda x: F.replace(F.lower(x), F.lit(".pdf"), F.lit("")))
    def share(p):
        hits = F.filter(p["e"], lambda e: F.exists(p["r"], lambda r: e.contains(r) | r.contains(e)))
        return F.coalesce(F.try_divide(F.size(hits), F.size(p["e"])), F.lit(0.0))
    return T.let(F.struct(norm(expected).alias("e"), norm(retrieved).alias("r")), share)


def citation_quality(answer: Column, n_sources: Column) -> Column:
    return C.validate(answer, n_sources)


# ------------------------------------------------------------------ per ranked list

def first_relevant_rank(results: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, first_rank) for every query; null when no relevant chunk was retrieved.

    relevant: query_id, chunk_id.
    """
    hit = results.join(relevant.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").join(hit, "query_id", "left")


def ranking_metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query: precision and recall at k, NDCG at k, first rank. Relevance is 0 or 1."""
    rel = relevant.select("query_id", "chunk_id").distinct()
    total = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = results.where(F.col("rank") <= k).join(rel, ["query_id", "chunk_id"])
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hit"), F.sum(gain).alias("dcg"), F.min("rank").alias("first_rank"))
    d = queries.select("query_id").join(total, "query_id", "left").join(got, "query_id", "left").fillna(0, ["n_relevant", "n_hit"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.when(F.col("n_relevant") > 0, F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")),
                        F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return d.select("query_id", (F.col("n_hit") / k).alias("precision"), F.coalesce(F.try_divide("n_hit", "n_relevant"), F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide("dcg", ideal), F.lit(0.0)).alias("ndcg"), "first_rank")


def mean_rank(rank: Column) -> Column:
    """Mean over found rows; 999 when none was found."""
    return F.coalesce(F.avg(rank), F.lit(999.0))


def compare_depths(ranks: DataFrame, group: str, small: int = 10, large: int = 20) -> DataFrame:
    """Hit rate at two list lengths per group and overall (group null), with the difference."""
    at = lambda k: F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int"))
    out = ranks.rollup(group).agg(at(small).alias("hit_small"), at(large).alias("hit_large"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("improvement", F.col("hit_large") - F.col("hit_small"))


def compare_orders(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: questions newly found, newly lost, moved up, moved down, and the net gain.

    Both: query_id, first_rank (null = not found).
    """
    a, b = F.col("before"), F.col("after")
    both = before.select("query_id", F.col("first_rank").alias("before")).join(after.select("query_id", F.col("first_rank").alias("after")), "query_id")
    out = both.agg(F.count_if(a.isNull() & b.isNotNull()).alias("newly_found"), F.count_if(a.isNotNull() & b.isNull()).alias("newly_lost"),
                   F.count_if(b < a).alias("improved"), F.count_if(b > a).alias("degraded"))
    return out.withColumn("net", F.col("newly_found") - F.col("newly_lost"))


def latency_change(before: Column, after: Column) -> Column:
    """Struct of the mean difference and its share of the former mean."""
    diff = F.avg(after) - F.avg(before)
    return F.struct(diff.alias("delta"), F.try_divide(diff, F.avg(before)).alias("share"))


def threshold_sweep(hits: DataFrame, queries: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: share of queries with a relevant document in the top 3, a relevant chunk in
    the top 10, and any hit at all. hits: query_id, rank, similarity, is_relevant, same_document.

    A hit's rank among those above a threshold is its rank, since hits are ordered by
    similarity; each hit is expanded to the thresholds it passes and one aggregation does the rest.
    """
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    per = hits.withColumn("threshold", F.explode(F.filter(grid, lambda t: F.col("similarity") > t))).groupBy("threshold", "query_id").agg(
        F.max(F.col("same_document") & (F.col("rank") <= 3)).alias("doc3"), F.max(F.col("is_relevant") & (F.col("rank") <= 10)).alias("chunk10"))
    n = queries.select(F.count(F.lit(1)).alias("n")).scalar()
    out = per.groupBy("threshold").agg(F.count_if("doc3").alias("a"), F.count_if("chunk10").alias("b"), F.count(F.lit(1)).alias("c"))
    return out.select("threshold", (F.col("a") / n).alias("doc_top3"), (F.col("b") / n).alias("chunk_top10"), (F.col("c") / n).alias("coverage"))


def score_thresholds(scores: DataFrame, keys: list[str], score: str, truth: str, at_least: float) -> DataFrame:
    """Precision, recall and F1 of 'score reaches the threshold' against a true label, and the plain pass share."""
    yes, real = F.col(score) >= at_least, F.col(truth)
    d = scores.groupBy(*keys).agg(F.count_if(yes & real).alias("tp"), F.count_if(yes).alias("p"), F.count_if(real).alias("t"), F.avg(yes.cast("int")).alias("pass_share"))
    prec, rec = F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "t"), F.lit(0.0))
    d = d.withColumn("precision", prec).withColumn("recall", rec)
    return d.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).drop("tp", "p", "t")


# ------------------------------------------------------------------ reports

def grouped_summary(results: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """Several groupings of one result table in a single pass (grouping sets).

    results: keyword_accuracy, article_match, passed, duration and the grouping columns.
    Columns outside a row's grouping are null; ``grouping`` tells which one it is.
    """
    cols = list(dict.fromkeys(c for g in groupings for c in g))
    sets = [[F.col(c) for c in g] for g in groupings]
    out = results.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.grouping_id(*[F.col(c) for c in cols]).alias("grouping"), F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.avg("keyword_accuracy").alias("avg_accuracy"), F.avg(F.col("article_match").cast("int")).alias("article_rate"), F.avg("duration").alias("avg_duration"))
    return out.withColumn("pass_rate", F.col("passed") / F.col("total")).withColumn("overall", (F.col("avg_accuracy") + F.col("article_rate")) / 2)


def model_summary(results: DataFrame, categories: DataFrame, models: DataFrame) -> DataFrame:
    """Per model and category: count, mean score, success rate; a category without results shows 0.

    categories and models are the two small name lists of a run; their grid is at most
    their product. results: model, category, total_score, error.
    """
    ok = F.col("error").isNull() & (F.col("total_score") > 0)
    agg = results.groupBy("model", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("total_score").alias("avg_score"), F.avg(ok.cast("int")).alias("success_rate"))
    names = categories.agg(F.array_sort(F.collect_set("category")).alias("c")).select("c").scalar()
    grid = models.select("model").distinct().withColumn("category", F.explode(names))
    return grid.join(agg, ["model", "category"], "left").fillna(0, ["n"]).fillna(0.0, ["avg_score", "success_rate"])


def weak_categories(summary: DataFrame, below: float = 0.7) -> DataFrame:
    return summary.where(F.col("success_rate") < below).orderBy("success_rate", "category")


def best_and_fastest(summary: DataFrame) -> DataFrame:
    """One row: model with the highest score and with the lowest time; first by name on ties."""
    return summary.agg(F.min_by("model", F.struct(-F.col("avg_score"), "model")).alias("best_model"),
                       F.min_by("model", F.struct("avg_time", "model")).alias("fastest_model"))


def first_failures(results: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` failed results by ``order``, numbered, with the reason and the number of all failures.

    A result failed if it has an error or a score of at most 0. results: total_score, error
    and the columns of ``order``; columns of the result: those, failure_no, reason, n_failures.
    """
    failed = results.where(F.col("error").isNotNull() | (F.col("total_score") <= 0))
    first = failed.orderBy(*order).limit(n).withColumn("reason", F.coalesce("error", F.lit("Score 0")))
    numbered = first.withColumn("failure_no", F.row_number().over(Window.orderBy(*order)))  # n rows
    total = failed.agg(F.count(F.lit(1)).alias("n_failures"))
    return numbered.join(F.broadcast(total)).select(*order, "failure_no", "reason", "n_failures")


def frequent_missing(results: DataFrame, keys: list[str], missing: str = "missing", n: int = 5) -> DataFrame:
    """The n most frequently missing keywords per key."""
    counts = results.select(*keys, F.explode(missing).alias("keyword")).groupBy(*keys, "keyword").agg(F.count(F.lit(1)).alias("n"))
    if keys:
        return top_k(counts, keys, [F.col("n").desc(), F.col("keyword")], n)
    return counts.orderBy(F.col("n").desc(), "keyword").limit(n)


def configuration_totals(results: DataFrame, key: str) -> DataFrame:
    """Totals per configuration: pass rate, overall score, cost, tokens, cost per query."""
    d = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.avg("keyword_accuracy").alias("avg_accuracy"),
        F.avg(F.col("article_match").cast("int")).alias("article_rate"), F.avg("duration").alias("avg_duration"), F.sum("cost").alias("total_cost"), F.sum("tokens").alias("total_tokens"))
    return d.withColumns({"pass_rate": F.col("passed") / F.col("total"), "overall": (F.col("avg_accuracy") + F.col("article_rate")) / 2, "cost_per_query": F.col("total_cost") / F.col("total")})


def run_grid(questions: DataFrame, configurations: list[tuple[str, int]]) -> DataFrame:
    """Every question once per configuration (name, n_documents): the input of a grid run in one job."""
    rows = F.array(*[F.struct(F.lit(n).alias("configuration"), F.lit(d).alias("n_documents")) for n, d in configurations])
    return questions.withColumn("__c", F.explode(rows)).select(*questions.columns, "__c.*")


def paired_runs(results: DataFrame, key: str, configurations: list[str], measure: str) -> DataFrame:
    """One row per question with a measure of every configuration, joined on the question id."""
    return results.groupBy(key).pivot("configuration", configurations).agg(F.first(measure))


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference of two metric tables (metric, value)."""
    return before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0, hasher=None) -> DataFrame:
    """ceil(n / strata) rows per stratum in seeded hash order, n in all, strata in order: the
    sampling operator. Stopping at n while filling and cutting at n afterwards give the same rows.
    """
    order = hasher(F.col(key)) if hasher else F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    strata = rows.select(F.count_distinct(stratum).alias("n")).select("n").scalar()
    per = F.ceil(F.lit(n) / strata)
    # no stratum can give more than n rows, so n bounds the first cut
    drawn = top_k(rows.withColumn("__order", order), [stratum], [F.col("__order"), F.col(key)], n, "draw").where(F.col("draw") <= per).drop("__order")
    return drawn.orderBy(stratum, "draw").limit(n)


def first_seen_distinct(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Distinct values per key with the place each was first seen."""
    return rows.groupBy(*keys, value).agg(F.min(pos).alias("first_pos"))


def retry_average(rows: DataFrame, ok: Column, value: str) -> DataFrame:
    """Mean over successful rows only."""
    return rows.where(ok).agg(F.avg(value).alias("avg"), F.count(F.lit(1)).alias("n"))


def answer_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keyword recall, answer rate and mean time. rows: accuracy, answer, duration, confidence."""
    return rows.groupBy(*keys).agg(
        F.avg("accuracy").alias("keyword_recall"), F.avg(answered(F.col("answer")).cast("int")).alias("answer_rate"), F.avg("duration").alias("avg_time"),
        F.avg((F.col("confidence") == "high").cast("int")).alias("high_confidence_share"))
