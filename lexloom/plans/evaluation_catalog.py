"""Catalogue: evaluation of answers and of retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import evaluation as E, ordered, rerank as RR, search as S
from lexloom.plans.common import ANSWERS_SQL, answers, query, table, texts
from lexloom.plans.search_catalog import DOCS, EV, LC, QV, bench_queries, corpus, doc_vectors, docs, kw_sql, label_centres, sem_sql, vectors
from lexloom.session import checkpoint
from lexloom.sources import sinks


def _big(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


_WORDS = ["tax;rate", "AED", " 3 months ; 9 months", "relief"]


@query("keyword_accuracy", f"""WITH {ANSWERS_SQL}, e AS (SELECT *, CASE WHEN question_id % 4 = 0 THEN [] ELSE ['tax;rate', 'AED', ' 3 months ; 9 months', 'relief'] END AS w FROM answers),
f AS (SELECT *, list_filter(w, lambda k: len(list_filter(string_split(k, ';'), lambda a: contains(lower(answer), lower(trim(a))))) > 0) AS found FROM e)
SELECT question_id, array_to_string(found, '|') AS found, array_to_string(list_filter(w, lambda k: NOT list_contains(found, k)), '|') AS missing,
  CASE WHEN len(w) = 0 THEN 1.0 ELSE len(found) / len(w) END::DOUBLE AS accuracy, len(w) = 0 OR len(found) / len(w) >= 0.5 AS passed FROM f""")
def keyword_accuracy(spark, sf):
    d = _checked(spark, sf)
    return d.select("question_id", F.array_join("k.found", "|").alias("found"), F.array_join("k.missing", "|").alias("missing"), "k.accuracy", "passed")


def _checked(spark, sf):
    d = answers(spark, sf).withColumn("w", F.when(F.col("question_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(w) for w in _WORDS])))
    d = d.withColumn("k", E.keyword_check(F.col("answer"), F.col("w")))
    return d.withColumn("passed", E.passes(F.col("k.accuracy"), F.col("w")))


@query("article_match", f"""WITH {ANSWERS_SQL} SELECT question_id, question_id % 5 = 0 OR contains(lower(answer), 'article ' || (question_id % 9 + 1)) OR contains(lower(answer), 'section ' || (question_id % 7 + 1)) AS matched,
  length(answer) > 50 AND NOT contains(lower(answer), 'sorry') AS answered FROM answers""")
def article_match(spark, sf):
    n = F.col("question_id")
    exp = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Article "), n % 9 + 1), F.concat(F.lit("SECTION "), n % 7 + 1)))
    return answers(spark, sf).select("question_id", E.article_match(F.col("answer"), exp).alias("matched"), E.answered(F.col("answer")).alias("answered"))


WEIGHTS = {
    "retrieval": {"correct_article_retrieved": 10.0, "correct_section_retrieved": 5.0, "partial_match": 1.0},
    "generation": {"must_contain_all": 20.0, "must_contain_partial": 5.0, "should_contain_bonus": 2.0, "hallucination": -10.0},
    "citation": {"correct_inline_citation": 5.0, "correct_source_cited": 2.0, "missing_citation": -1.0},
}


def evaluated(spark, sf):
    n = F.col("question_id")
    lits = lambda *w: F.array(*[F.lit(x) if isinstance(x, str) else x for x in w])
    src = F.when(F.col("n_sources") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n_sources")), lambda i: F.struct(
        F.concat(F.lit("Article "), i).alias("section_path"), F.concat(F.lit("see section "), i + 10).alias("content")))).otherwise(
        F.array().cast("array<struct<section_path:string,content:string>>"))
    rows = answers(spark, sf).select(
        "question_id", "question", F.col("answer").alias("response"), src.alias("sources"), lits("9%", "months").alias("must_contain"), lits("relief", "AED").alias("should_contain"),
        lits("sorry").alias("must_not_contain"), lits(F.concat(F.lit("Article "), n % 7 + 1)).alias("expected_articles"), lits(F.concat(F.lit("SECTION "), n % 9 + 10)).alias("expected_sections"),
        F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(lits("tax", "rate")).alias("expected_keywords"))
    return E.evaluate(rows, WEIGHTS)


def _n(words):
    return " + ".join(f"contains(lower(answer), '{w}')::INT" for w in words)


EVAL_SQL = rf"""{ANSWERS_SQL}, m AS (SELECT *, len(list_distinct(regexp_extract_all(answer, '\[(\d+)\]', 1))) AS used,
  list_filter(string_split(answer, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '') AS paras,
  {_n(['9%', 'months'])} AS must, {_n(['relief', 'aed'])} AS should, {_n(['sorry'])} AS bad, {_n(['tax', 'rate'])} AS kw,
  len(list_filter(range(1, n_sources + 1), lambda i: contains('article ' || i || ' see section ' || (i + 10), 'article ' || (question_id % 7 + 1)))) > 0 AS art,
  len(list_filter(range(1, n_sources + 1), lambda i: contains('article ' || i || ' see section ' || (i + 10), 'section ' || (question_id % 9 + 10)))) > 0 AS sec FROM answers),
i AS (SELECT *, len(list_filter(paras, lambda p: regexp_matches(p, '\[\d+\]'))) > 1 OR (len(paras) = 1 AND used > 0) AS inl FROM m),
ev AS (SELECT question_id, question, (art::INT * 10 + sec::INT * 5 + greatest(0, n_sources - art::INT - sec::INT))::DOUBLE AS retrieval_score,
  (CASE WHEN must = 2 THEN 20 ELSE must * 5 END + should * 2 - bad * 10)::DOUBLE AS generation_score,
  (CASE WHEN inl THEN 5 ELSE 0 END + used * 2 - (n_sources - used))::DOUBLE AS citation_score, inl AS inline_citations, used AS citation_count, NOT inl AND used > 0 AS placement_problem,
  CASE WHEN n_sources > 0 THEN art::INT / n_sources ELSE 0 END::DOUBLE AS retrieval_precision, art::INT::DOUBLE AS retrieval_recall, CASE WHEN question_id % 4 = 0 THEN 1 ELSE kw / 2 END::DOUBLE AS keyword_accuracy,
  CASE WHEN n_sources > 0 THEN least(used, n_sources) / n_sources ELSE 0 END::DOUBLE AS citation_accuracy FROM i)"""


@query("eval_full", f"""WITH {EVAL_SQL} SELECT question_id, retrieval_score, generation_score, citation_score, retrieval_score + generation_score + citation_score AS total_score, inline_citations, placement_problem,
citation_count::BIGINT AS citation_count, round(retrieval_precision, 6) AS retrieval_precision, retrieval_recall, keyword_accuracy, round(citation_accuracy, 6) AS citation_accuracy FROM ev""")
def eval_full(spark, sf):
    return evaluated(spark, sf).select(
        "question_id", "retrieval_score", "generation_score", "citation_score", "total_score", "inline_citations", "placement_problem", F.col("citation_count").cast("bigint").alias("citation_count"),
        F.round("retrieval_precision", 6).alias("retrieval_precision"), "retrieval_recall", "keyword_accuracy", F.round("citation_accuracy", 6).alias("citation_accuracy"))


@query("model_category", f"""WITH {EVAL_SQL}, r AS (SELECT ['m1', 'm2', 'm3'][(question_id % 3 + 1)::INT] AS model, 'c' || (question_id % 4) AS category, retrieval_score + generation_score + citation_score AS s FROM ev),
g AS (SELECT m.model, c.category FROM (SELECT DISTINCT model FROM r) m, (SELECT DISTINCT category FROM r UNION SELECT 'c9') c)
SELECT g.model, g.category, count(s) AS n, round(coalesce(avg(s), 0), 6) AS avg_score, round(coalesce(avg((s > 0)::INT), 0), 6) AS success_rate FROM g LEFT JOIN r USING (model, category) GROUP BY 1, 2""")
def model_category(spark, sf):
    n = F.col("question_id")
    model = F.element_at(F.array(*[F.lit(m) for m in ("m1", "m2", "m3")]), (n % 3 + 1).cast("int"))
    r = evaluated(spark, sf).select(model.alias("model"), F.concat(F.lit("c"), n % 4).alias("category"), "total_score", F.lit(None).cast("string").alias("error"))
    cats = r.select("category").distinct().unionByName(r.agg(F.lit("c9").alias("category")))
    d = E.model_summary(r, cats, r)
    return d.select("model", "category", "n", F.round("avg_score", 6).alias("avg_score"), F.round("success_rate", 6).alias("success_rate"))


@query("missing_keywords", f"""WITH {ANSWERS_SQL}, m AS (SELECT question_id % 3 AS run, unnest(list_filter(['tax;rate', 'AED', ' 3 months ; 9 months', 'relief'], lambda k: len(list_filter(string_split(k, ';'), lambda a: contains(lower(answer), lower(trim(a))))) = 0)) AS keyword
  FROM answers WHERE question_id % 4 <> 0), c AS (SELECT run, keyword, count(*) AS n FROM m GROUP BY 1, 2)
SELECT run, keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, keyword) AS rank FROM c) WHERE rank <= 5""")
def missing_keywords(spark, sf):
    d = _checked(spark, sf).select((F.col("question_id") % 3).alias("run"), F.col("k.missing").alias("missing"))
    return _big(E.frequent_missing(d, ["run"]), "rank")


# ------------------------------------------------------------------ results table: documents with labels

_RES = """res AS (SELECT d.doc_id, lang AS category, source AS difficulty, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS topic, quality / 1.0 AS acc, toxic = 0 AS art, quality = 1 AND toxic = 0 AS ok, n_chars AS duration FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def results(spark, sf):
    d = texts(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", F.col("lang").alias("category"), F.col("source").alias("difficulty"), F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("topic"),
                    F.col("quality").cast("double").alias("keyword_accuracy"), (F.col("toxic") == 0).alias("article_match"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), F.col("n_chars").alias("duration"))


@query("summary_grouping_sets", f"""WITH {_RES} SELECT category, difficulty, topic, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, round(avg(acc), 6) AS avg_accuracy, round(avg(art::INT), 6) AS article_rate,
  round(avg(duration), 6) AS avg_duration, round(count(*) FILTER (WHERE ok) / count(*), 6) AS pass_rate, round((avg(acc) + avg(art::INT)) / 2, 6) AS overall FROM res GROUP BY GROUPING SETS ((category), (difficulty), (topic), ())""")
def summary_grouping_sets(spark, sf):
    d = E.grouped_summary(results(spark, sf), [["category"], ["difficulty"], ["topic"], []]).drop("grouping")
    return d.withColumns({c: F.round(c, 6) for c in ("avg_accuracy", "article_rate", "avg_duration", "pass_rate", "overall")})


_LI = "li AS (SELECT l_returnflag || l_linestatus AS configuration, l_tax * 10 AS acc, l_discount > 0.05 AS art, l_quantity > 20 AS ok, l_extendedprice AS duration, l_extendedprice / 1000000 AS cost, l_quantity::BIGINT AS tokens, l_orderkey, l_linenumber, l_partkey FROM lineitem)"


def runs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("configuration"), (F.col("l_tax") * 10).alias("keyword_accuracy"), (F.col("l_discount") > 0.05).alias("article_match"), (F.col("l_quantity") > 20).alias("passed"),
        F.col("l_extendedprice").alias("duration"), (F.col("l_extendedprice") / 1000000).alias("cost"), F.col("l_quantity").cast("bigint").alias("tokens"), "l_orderkey", "l_linenumber", "l_partkey")


@query("configuration_totals", f"""WITH {_LI} SELECT configuration, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, round(avg(acc), 6) AS avg_accuracy, round(avg(art::INT), 6) AS article_rate, round(avg(duration), 4) AS avg_duration,
round(sum(cost), 4) AS total_cost, sum(tokens)::BIGINT AS total_tokens, round(count(*) FILTER (WHERE ok) / count(*), 6) AS pass_rate, round((avg(acc) + avg(art::INT)) / 2, 6) AS overall, round(sum(cost) / count(*), 8) AS cost_per_query FROM li GROUP BY 1""")
def configuration_totals(spark, sf):
    d = E.configuration_totals(runs(spark, sf), "configuration")
    digits = {"avg_accuracy": 6, "article_rate": 6, "avg_duration": 4, "total_cost": 4, "pass_rate": 6, "overall": 6, "cost_per_query": 8}
    return d.withColumns({c: F.round(c, n) for c, n in digits.items()})


_SCORED = "li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 AND l_discount > 0.07 THEN 'timeout' END AS error, l_tax * 10 - 0.1 AS total_score, l_returnflag || l_linestatus AS model, l_extendedprice AS ms FROM lineitem)"


def scored(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when((F.col("l_quantity") < 3) & (F.col("l_discount") > 0.07), "timeout").alias("error"),
        (F.col("l_tax") * 10 - 0.1).alias("total_score"), F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_extendedprice").alias("ms"))


@query("first_failures", f"""WITH {_SCORED}, f AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS failure_no, count(*) OVER () AS n_failures FROM li WHERE error IS NOT NULL OR total_score <= 0)
SELECT l_orderkey, l_linenumber, failure_no, coalesce(error, 'Score 0') AS reason, n_failures FROM f WHERE failure_no <= 10""")
def first_failures(spark, sf):
    return E.first_failures(scored(spark, sf), ["l_orderkey", "l_linenumber"]).withColumn("failure_no", F.col("failure_no").cast("bigint"))


@query("best_and_fastest", f"""WITH {_SCORED}, s AS (SELECT model, round(avg(total_score), 6) AS a, round(avg(ms), 4) AS t FROM li GROUP BY 1)
SELECT (SELECT model FROM s ORDER BY a DESC, model LIMIT 1) AS best_model, (SELECT model FROM s ORDER BY t, model LIMIT 1) AS fastest_model""")
def best_and_fastest(spark, sf):
    s = scored(spark, sf).groupBy("model").agg(F.round(F.avg("total_score"), 6).alias("avg_score"), F.round(F.avg("ms"), 4).alias("avg_time"))
    return E.best_and_fastest(s)


_WIDE = ", ".join(
    f"""max(CASE WHEN p = '{i}' THEN (n > 1)::VARCHAR END) AS "P{i}_passed", max(CASE WHEN p = '{i}' THEN (n % 100)::INT || '%' END) AS "P{i}_accuracy",
  max(CASE WHEN p = '{i}' THEN n::VARCHAR END) AS "P{i}_duration_ms", max(CASE WHEN p = '{i}' THEN printf('%.5f', n / 8.0) END) AS "P{i}_cost_usd",
  max(CASE WHEN p = '{i}' THEN 'two lines ' || n END) AS "P{i}_answer\"""" for i in range(1, 6))


@query("configuration_wide", f"""WITH r AS (SELECT o_custkey AS id, o_orderpriority[1:1] AS p, max(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT id::VARCHAR AS id, 'q' || id AS query, 'c' || (id % 3) AS category, 'easy' AS difficulty,
  {_WIDE}
FROM r GROUP BY id""")
def configuration_wide(spark, sf):
    r = table(spark, sf, "orders").groupBy("o_custkey", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("configuration")).agg(F.count(F.lit(1)).alias("n"))
    i = F.col("o_custkey")
    rows = r.select(i.cast("string").alias("id"), F.concat(F.lit("q"), i).alias("query"), F.concat(F.lit("c"), i % 3).alias("category"), F.lit("easy").alias("difficulty"), "configuration",
                    (F.col("n") > 1).alias("passed"), ((F.col("n") % 100) / 100).alias("accuracy"), F.col("n").alias("duration"), (F.col("n") / 8.0).alias("cost"), F.concat(F.lit("two\nlines "), "n").alias("response"))
    return sinks.comparison_rows(rows, [f"P{i}" for i in range(1, 6)])


@query("paired_runs", """SELECT o_custkey AS id, max(CASE WHEN o_orderstatus = 'F' THEN t END) AS "F", max(CASE WHEN o_orderstatus = 'O' THEN t END) AS "O", max(CASE WHEN o_orderstatus = 'P' THEN t END) AS "P"
FROM (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS t FROM orders GROUP BY 1, 2) GROUP BY 1""")
def paired_runs(spark, sf):
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("configuration")).agg(F.max("o_totalprice").alias("t"))
    return E.paired_runs(r, "id", ["F", "O", "P"], "t")


@query("configuration_grid", """SELECT configuration, n_documents::BIGINT AS n_documents, count(*) AS n, count(*) FILTER (WHERE l >= n_documents) AS enough FROM (SELECT c_custkey, c_custkey % 12 AS l FROM customer),
(VALUES ('one', 1), ('three', 3), ('five', 5), ('ten', 10)) g(configuration, n_documents) GROUP BY 1, 2""")
def configuration_grid(spark, sf):
    d = E.run_grid(table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 12).alias("l")), [("one", 1), ("three", 3), ("five", 5), ("ten", 10)])
    return _big(d.groupBy("configuration", "n_documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l") >= F.col("n_documents")).alias("enough")), "n_documents")


@query("stratified_sample", """WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS draw FROM documents),
p AS (SELECT * FROM s WHERE draw <= ceil(50 / (SELECT count(DISTINCT lang) FROM documents))) SELECT doc_id, lang, draw FROM p ORDER BY lang, draw LIMIT 50""")
def stratified_sample(spark, sf):
    d = E.stratified_sample(texts(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 50, hasher=lambda c: F.md5(c.cast("string").cast("binary")))
    return _big(d, "draw")


@query("score_thresholds", """SELECT lang, round(avg((n_chars >= 1000)::INT), 6) AS pass_share, round(count(*) FILTER (WHERE n_chars >= 1000 AND quality = 1) / nullif(count(*) FILTER (WHERE n_chars >= 1000), 0), 6) AS precision,
round(count(*) FILTER (WHERE n_chars >= 1000 AND quality = 1) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6) AS recall FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def score_thresholds(spark, sf):
    d = texts(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("real", F.col("quality") == 1)
    out = E.score_thresholds(d, ["lang"], "n_chars", "real", 1000)
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("pass_share", "precision", "recall")])


# ------------------------------------------------------------------ ranked lists; relevance = same label

_REL = "rel AS (SELECT label AS query_id, vec_id AS chunk_id FROM embeddings)"


def relevant(spark, sf):
    return vectors(spark, sf).select(F.col("label").cast("bigint").alias("query_id"), "chunk_id")


@query("recall_at_k", f"""WITH {LC}, {EV}, {_REL}, {sem_sql(10, 'lc', 'ev')}, h AS (SELECT s.query_id, count(*) AS n_hit, min(rank) AS first_rank FROM sem s JOIN rel r ON s.query_id = r.query_id AND s.chunk_id = r.chunk_id GROUP BY 1),
t AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)
SELECT t.query_id::BIGINT AS query_id, round(coalesce(n_hit, 0) / 10, 6) AS precision, round(coalesce(n_hit, 0) / n, 6) AS recall, first_rank FROM t LEFT JOIN h USING (query_id)""")
def recall_at_k(spark, sf):
    qs = label_centres(spark, sf)
    d = E.ranking_metrics(S.semantic_topk(qs, vectors(spark, sf), 10), relevant(spark, sf), qs, 10)
    return _big(d.select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "first_rank"), "first_rank")


@query("ndcg_at_k", f"""WITH {LC}, {EV}, {_REL}, {sem_sql(10, 'lc', 'ev')}, h AS (SELECT s.query_id, sum(1 / log2(rank + 1)) AS dcg FROM sem s JOIN rel r ON s.query_id = r.query_id AND s.chunk_id = r.chunk_id GROUP BY 1),
t AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)
SELECT t.query_id::BIGINT AS query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM t LEFT JOIN h USING (query_id)""")
def ndcg_at_k(spark, sf):
    qs = label_centres(spark, sf)
    d = E.ranking_metrics(S.semantic_topk(qs, vectors(spark, sf), 10), relevant(spark, sf), qs, 10)
    return d.select("query_id", F.round("ndcg", 6).alias("ndcg"))


# a benchmark text's relevant documents are those holding all its terms
_TEXT_REL = kw_sql(None, "and", name="al")


@query("topk_compare", f"""WITH {QV}, {DOCS}, {_TEXT_REL}, {kw_sql(20, 'or')},
f AS (SELECT k.query_id, min(k.rank) AS r FROM kw k JOIN al ON al.query_id = k.query_id AND al.chunk_id = k.chunk_id GROUP BY 1),
g AS (SELECT q.query_id, (length(q.text) // 100)::BIGINT AS span, r FROM qv q LEFT JOIN f USING (query_id))
SELECT span, count(*) AS n, round(avg(coalesce(r <= 10, false)::INT), 6) AS hit_small, round(avg(coalesce(r <= 20, false)::INT), 6) AS hit_large, round(avg(coalesce(r <= 20, false)::INT) - avg(coalesce(r <= 10, false)::INT), 6) AS improvement
FROM g GROUP BY ROLLUP (span)""")
def topk_compare(spark, sf):
    qs, c = bench_queries(spark, sf), docs(spark, sf)
    terms = S.query_terms(qs)
    ranks = E.first_relevant_rank(S.keyword_topk(terms, c, 20, "or"), S.keyword_scores(terms, c, "and"), qs)
    ranks = ranks.join(qs.select("query_id", F.floor(F.length("text") / 100).alias("span")), "query_id")
    return E.compare_depths(ranks, "span").withColumns({x: F.round(x, 6) for x in ("hit_small", "hit_large", "improvement")})


@query("topk_compare_multi", f"""WITH {QV}, {DOCS}, {_TEXT_REL}, {kw_sql(20, 'or')},
f AS (SELECT k.query_id, min(k.rank) AS r FROM kw k JOIN al ON al.query_id = k.query_id AND al.chunk_id = k.chunk_id GROUP BY 1),
m AS (SELECT al.query_id, count(DISTINCT source) > 1 AS multi FROM al JOIN cv USING (chunk_id) GROUP BY 1), g AS (SELECT multi, r FROM m LEFT JOIN f USING (query_id))
SELECT multi, count(*) AS n, round(avg(coalesce(r <= 10, false)::INT), 6) AS hit_small, round(avg(coalesce(r <= 20, false)::INT), 6) AS hit_large, round(avg(coalesce(r <= 20, false)::INT) - avg(coalesce(r <= 10, false)::INT), 6) AS improvement
FROM g GROUP BY ROLLUP (multi)""")
def topk_compare_multi(spark, sf):
    """Hit rates of texts that several documents answer, and of the others."""
    qs, c = bench_queries(spark, sf), docs(spark, sf)
    terms = S.query_terms(qs)
    relevant = checkpoint(S.keyword_scores(terms, c, "and").select("query_id", "chunk_id"), "relevant")
    sources = relevant.join(corpus(spark, sf).select("chunk_id", "source"), "chunk_id").groupBy("query_id").agg((F.count_distinct("source") > 1).alias("multi"))
    ranks = E.first_relevant_rank(S.keyword_topk(terms, c, 20, "or"), relevant, sources).join(sources, "query_id")
    return E.compare_depths(ranks, "multi").withColumns({x: F.round(x, 6) for x in ("hit_small", "hit_large", "improvement")})


@query("rerank_compare", f"""WITH {QV}, {DOCS}, {_TEXT_REL}, {sem_sql(50)}, {kw_sql(50, 'or')},
a AS (SELECT q.query_id, min(s.rank) AS r FROM qv q LEFT JOIN (SELECT sem.* FROM sem JOIN al ON al.query_id = sem.query_id AND al.chunk_id = sem.chunk_id) s USING (query_id) GROUP BY 1),
b AS (SELECT q.query_id, min(s.rank) AS r FROM qv q LEFT JOIN (SELECT kw.* FROM kw JOIN al ON al.query_id = kw.query_id AND al.chunk_id = kw.chunk_id) s USING (query_id) GROUP BY 1)
SELECT count(*) FILTER (WHERE a.r IS NULL AND b.r IS NOT NULL) AS newly_found, count(*) FILTER (WHERE a.r IS NOT NULL AND b.r IS NULL) AS newly_lost, count(*) FILTER (WHERE b.r < a.r) AS improved, count(*) FILTER (WHERE b.r > a.r) AS degraded,
 count(*) FILTER (WHERE a.r IS NULL AND b.r IS NOT NULL) - count(*) FILTER (WHERE a.r IS NOT NULL AND b.r IS NULL) AS net FROM a JOIN b USING (query_id)""")
def rerank_compare(spark, sf):
    """Rank of relevant documents in the vector order against the keyword order."""
    qs, c, vec = bench_queries(spark, sf), docs(spark, sf), doc_vectors(spark, sf)
    terms = S.query_terms(qs)
    rel = S.keyword_scores(terms, c, "and")
    return E.compare_orders(E.first_relevant_rank(S.semantic_topk(qs, vec, 50), rel, qs), E.first_relevant_rank(S.keyword_topk(terms, c, 50, "or"), rel, qs))


@query("threshold_sweep", f"""WITH {LC}, {EV}, {sem_sql(10, 'lc', 'ev')}, h AS (SELECT s.*, label = query_id AS rel, label % 5 = query_id % 5 AS doc FROM sem s JOIN ev USING (chunk_id)),
p AS (SELECT threshold, query_id, max((doc AND rank <= 3)::INT) AS d3, max((rel AND rank <= 10)::INT) AS c10 FROM h, (VALUES (0.25), (0.3), (0.35), (0.4), (0.5), (0.75)) t(threshold) WHERE similarity > threshold GROUP BY 1, 2)
SELECT threshold::DOUBLE AS threshold, round(sum(d3) / (SELECT count(*) FROM lc), 6) AS doc_top3, round(sum(c10) / (SELECT count(*) FROM lc), 6) AS chunk_top10, round(count(*) / (SELECT count(*) FROM lc), 6) AS coverage FROM p GROUP BY 1""")
def threshold_sweep(spark, sf):
    qs, e = label_centres(spark, sf), vectors(spark, sf)
    h = S.semantic_topk(qs, e, 10).join(e.select("chunk_id", "label"), "chunk_id")
    h = h.withColumn("is_relevant", F.col("label") == F.col("query_id")).withColumn("same_document", F.col("label") % 5 == F.col("query_id") % 5)
    d = E.threshold_sweep(h, qs, [0.25, 0.3, 0.35, 0.4, 0.5, 0.75])
    return d.select("threshold", *[F.round(x, 6).alias(x) for x in ("doc_top3", "chunk_top10", "coverage")])


@query("document_recall", f"""WITH {QV}, {DOCS}, {sem_sql(10)}, r AS (SELECT query_id, list_distinct(list(source ORDER BY rank)) AS got FROM sem JOIN cv USING (chunk_id) GROUP BY 1),
e AS (SELECT query_id, got, list_transform([query_id % 20, (query_id * 7) % 20, (query_id + 3) % 20], lambda i: 'src' || i) AS want FROM r)
SELECT query_id, round(len(list_filter(want, lambda w: len(list_filter(got, lambda g: contains(w, g) OR contains(g, w))) > 0)) / 3, 6) AS recall FROM e""")
def document_recall(spark, sf):
    hits = S.semantic_topk(bench_queries(spark, sf), corpus(spark, sf), 10).join(corpus(spark, sf).select("chunk_id", "source"), "chunk_id")
    names = E.first_seen_distinct(hits, ["query_id"], "source", "rank").groupBy("query_id").agg(F.collect_list("source").alias("got"))  # at most 10 per query
    i = F.col("query_id")
    want = F.transform(F.array(i % 20, (i * 7) % 20, (i + 3) % 20), lambda n: F.concat(F.lit("SRC"), n, F.lit(".pdf")))
    return names.select("query_id", F.round(E.document_recall(want, F.col("got")), 6).alias("recall"))


@query("sources_per_document", f"""WITH {QV}, {DOCS}, {sem_sql(20)}, a AS (SELECT query_id, source AS document_id, chunk_id, rank FROM sem JOIN cv USING (chunk_id)),
f AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS document_pos FROM a GROUP BY 1, 2),
d AS (SELECT a.*, document_pos, row_number() OVER (PARTITION BY query_id, document_id ORDER BY a.rank) AS document_rank FROM a JOIN f USING (query_id, document_id))
SELECT query_id, document_id, chunk_id, rank FROM (SELECT query_id, document_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY document_pos, document_rank) AS rank FROM d WHERE document_rank <= 2) WHERE rank <= 5""")
def sources_per_document(spark, sf):
    a = S.semantic_topk(bench_queries(spark, sf), corpus(spark, sf), 20).join(corpus(spark, sf).select("chunk_id", F.col("source").alias("document_id")), "chunk_id").withColumnRenamed("rank", "pos")
    first = E.first_seen_distinct(a, ["query_id"], "document_id", "pos")
    docs = ordered.row_index(first, ["query_id"], ["first_pos"], "document_pos", start=1).drop("first_pos")
    out = RR.sources_per_document(a.join(docs, ["query_id", "document_id"]), 2, 5)
    return _big(out.select("query_id", "document_id", "chunk_id", "rank"), "rank")


@query("best_document", """WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'P' THEN 'medium' ELSE 'low' END AS confidence, o_orderkey % 4 AS n_sources FROM orders)
SELECT query_id, document_id, confidence, n_sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, n_sources DESC, document_id) AS k FROM r) WHERE k = 1""")
def best_document(spark, sf):
    level = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "P", "medium").otherwise("low")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("document_id"), level.alias("confidence"), (F.col("o_orderkey") % 4).alias("n_sources"), F.col("o_orderkey").alias("pos"))
    return RR.best_document(r).drop("pos")


@query("answer_report", f"""WITH {ANSWERS_SQL} SELECT question_id % 3 AS run, round(avg(length(answer)), 6) AS avg_time, round(avg((length(answer) > 50 AND NOT contains(lower(answer), 'sorry'))::INT), 6) AS answer_rate, round(avg((question_id % 2 = 0)::INT), 6) AS high_confidence_share FROM answers GROUP BY 1""")
def answer_report(spark, sf):
    d = answers(spark, sf).select((F.col("question_id") % 3).alias("run"), F.lit(1.0).alias("accuracy"), "answer", F.length("answer").alias("duration"), F.when(F.col("question_id") % 2 == 0, "high").otherwise("low").alias("confidence"))
    return E.answer_report(d, ["run"]).select("run", *[F.round(x, 6).alias(x) for x in ("avg_time", "answer_rate", "high_confidence_share")])
