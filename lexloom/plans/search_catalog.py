"""Catalogue: search and retrieval.

The corpus is every document with the vector of the same number, where there is one; the
queries are all benchmark texts with the vector of theirs.
"""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from lexloom import vocab
from lexloom.functions import scoring, text as T, vectors as V
from lexloom.operators import index as IX, rerank as R, search as S
from lexloom.operators.ordered import top_k
from lexloom.plans.common import query, sql_list, sql_tokens, table, texts
from lexloom.session import shared_dir

K = 10


def corpus(spark, sf):
    d = texts(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return d.join(e, "chunk_id", "left")


def docs(spark, sf):
    """Texts alone, for searches that read no vectors."""
    return texts(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def doc_vectors(spark, sf):
    return corpus(spark, sf).select("chunk_id", "embedding")


def bench_queries(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return b.join(e, "query_id", "left")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def label_centres(spark, sf):
    """One query per label: the mean of its vectors."""
    return S.mean_query_vectors(vectors(spark, sf), "label").select(F.col("label").cast("bigint").alias("query_id"), "embedding")


QV = "qv AS (SELECT item_id AS query_id, b.text, embedding::DOUBLE[] AS qe FROM benchmark b LEFT JOIN embeddings e ON item_id = vec_id)"
DOCS = "cv AS (SELECT doc_id AS chunk_id, text, source, lang, embedding::DOUBLE[] AS ce FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"


def sem_sql(k, queries="qv", docs="cv", floor=None, name="sem"):
    keep = f" WHERE similarity > {floor}" if floor is not None else ""
    return f"""{name}_all AS (SELECT query_id, chunk_id, round(list_cosine_similarity(qe, ce), 9) AS similarity
  FROM {queries}, {docs} WHERE qe IS NOT NULL AND ce IS NOT NULL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM {name}_all{keep}) WHERE rank <= {k})"""


_TERMS = (f"list_distinct(list_filter({sql_tokens('text')}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(vocab.SEARCH_STOP_WORDS)}, w)))")


def kw_sql(k, match, queries="qv", docs="cv", name="kw", terms=_TERMS):
    keep = "WHERE n_hit = n_terms" if match == "and" else ""
    return f"""{name}_q AS (SELECT query_id, {terms} AS t FROM {queries}),
{name}_t AS (SELECT query_id, len(t) AS n_terms, unnest(t) AS term FROM {name}_q),
{name}_w AS (SELECT chunk_id, {sql_tokens('text')} AS w FROM {docs}),
{name}_p AS (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM {name}_w),
{name}_tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM {name}_p GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
{name}_st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM {name}_w),
{name}_sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score,
  count(*) AS n_hit, max(n_terms) AS n_terms FROM {name}_t JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_st GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_sc {keep}) {f"WHERE rank <= {k}" if k else ""})"""


def fuse_sql(k, a="sem", b="kw", ws=1.0, wk=1.0, name="fused"):
    return f"""{name}_b AS (SELECT coalesce(s.query_id, t.query_id) AS query_id, coalesce(s.chunk_id, t.chunk_id) AS chunk_id, s.rank AS semantic_rank, t.rank AS keyword_rank,
  round(coalesce({ws}::DOUBLE / (60 + s.rank), 0) + coalesce({wk}::DOUBLE / (60 + t.rank), 0), 9) AS rrf_score,
  CASE WHEN s.rank IS NOT NULL AND t.rank IS NOT NULL THEN 'semantic + keyword' WHEN s.rank IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS search_type
  FROM {a} s FULL JOIN {b} t ON s.query_id = t.query_id AND s.chunk_id = t.chunk_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM {name}_b) WHERE rank <= {k})"""


def _big(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


LC = "lc AS (SELECT label AS query_id, list(x ORDER BY i) AS qe FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"
EV = "ev AS (SELECT vec_id AS chunk_id, label, embedding::DOUBLE[] AS ce FROM embeddings)"


@query("semantic_topk", f"WITH {LC}, {EV}, {sem_sql(K, 'lc', 'ev')} SELECT query_id::BIGINT AS query_id, chunk_id, similarity, rank FROM sem")
def semantic_topk(spark, sf):
    return _big(S.semantic_topk(label_centres(spark, sf), vectors(spark, sf), K), "rank")


@query("semantic_multi_topk", f"""WITH ev AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS ce FROM embeddings), eq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings),
{sem_sql(K, 'eq', 'ev')} SELECT query_id, chunk_id, similarity, rank FROM sem""")
def semantic_multi_topk(spark, sf):
    e = vectors(spark, sf)
    return _big(S.semantic_topk(e.select(F.col("chunk_id").alias("query_id"), "embedding"), e, K), "rank")


@query("semantic_threshold", f"WITH {QV}, {DOCS}, {sem_sql(15, floor=0.25)} SELECT query_id, chunk_id, similarity, rank, source AS file_name, lang AS owner FROM sem JOIN cv USING (chunk_id)")
def semantic_threshold(spark, sf):
    c = corpus(spark, sf)
    hits = S.semantic_topk(bench_queries(spark, sf), c, 15, 0.25)
    return _big(hits.join(c.select("chunk_id", F.col("source").alias("file_name"), F.col("lang").alias("owner")), "chunk_id"), "rank")


@query("ann_topk_recall")
def ann_topk_recall(spark, sf):
    """Share of the exact top 10 that the approximate search finds, per query."""
    e, qs = vectors(spark, sf), bench_queries(spark, sf)
    model, cells = S.build_cells(e, 16)
    exact, near = S.semantic_topk(qs, e, K), S.ann_topk(qs, cells, model, K, 6)
    found = near.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


PROBED = 0.75  # share of the cells a query looks into: the vectors of this table are all but random, fewer cells find under nine of ten
_CELLS = f"""n AS (SELECT floor(sqrt(count(*)))::BIGINT AS step FROM embeddings), ce AS (SELECT vec_id // step AS cell, embedding::DOUBLE[] AS z FROM embeddings, n WHERE vec_id % step = 0),
q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings ON item_id = vec_id), v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
own AS (SELECT chunk_id, v, cell FROM (SELECT chunk_id, v, cell, row_number() OVER (PARTITION BY chunk_id ORDER BY round(list_cosine_similarity(v, z), 9) DESC, cell) AS r FROM v, ce) WHERE r = 1),
ask AS (SELECT query_id, qe, cell FROM (SELECT query_id, qe, cell, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qe, z), 9) DESC, cell) AS r FROM q, ce) WHERE r <= (SELECT ceil({PROBED} * count(*)) FROM ce)),
s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(qe, v), 9) AS similarity FROM ask JOIN own USING (cell)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) WHERE rank <= {K})"""


def _given_cells(spark, sf):
    """Evenly spaced vectors as centres, as many as the root of their number."""
    e = vectors(spark, sf)
    step = int(e.count() ** 0.5)
    centres = e.where(F.col("chunk_id") % step == 0).select(F.floor(F.col("chunk_id") / step).cast("int").alias("cell"), "embedding")
    return centres, math.ceil(PROBED * centres.count())


@query("ann_cell_topk", f"WITH {_CELLS} SELECT query_id, chunk_id, similarity, rank FROM near")
def ann_cell_topk(spark, sf):
    """The approximate search over given centres, whose number grows with the root of the corpus."""
    centres, probes = _given_cells(spark, sf)
    return _big(S.cell_topk(bench_queries(spark, sf), vectors(spark, sf), centres, K, probes), "rank")


@query("ann_cell_recall", f"""WITH {_CELLS}, x AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qe, v), 9) DESC, chunk_id) AS rank FROM q, v) WHERE rank <= {K}),
r AS (SELECT x.query_id, count(near.chunk_id) / count(*) AS recall FROM x LEFT JOIN near ON near.query_id = x.query_id AND near.chunk_id = x.chunk_id GROUP BY 1),
m AS (SELECT query_id, count(*) AS n_read FROM s GROUP BY 1)
SELECT query_id, recall, coalesce(n_read, 0) AS n_read FROM r LEFT JOIN m USING (query_id)""")
def ann_cell_recall(spark, sf):
    """Share of the exact ten best that it finds, and how many vectors it compares, per query."""
    e, qs, (centres, probes) = vectors(spark, sf), bench_queries(spark, sf), _given_cells(spark, sf)
    exact = S.semantic_topk(qs, e, K)
    near = S.cell_topk(qs, e, centres, K, probes).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    sizes = S.nearest_centres(e, centres, 1, "chunk_id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    read = S.nearest_centres(qs, centres, probes, "query_id").join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n_read"))
    recall = exact.join(near, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return recall.join(read, "query_id", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))


@query("cosine_pairs", """SELECT a.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""")
def cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    p = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").alias("b")), "doc_id")
    sim = V.cosine(F.col("a"), F.col("b"))
    return p.select("doc_id", F.round(sim, 6).alias("similarity"), F.round(1 - sim, 6).alias("distance"))


@query("vector_normalize", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))), 6) AS unit_sum, len(embedding) = 384 AS is_local FROM embeddings""")
def vector_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    unit = V.unit(F.col("embedding"))
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"),
                    F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"),
                    V.vector_by_length(F.col("embedding"), 384).isNotNull().alias("is_local"))


@query("keyword_search_and", f"WITH {QV}, {DOCS}, {kw_sql(K, 'and')} SELECT query_id, chunk_id, score, n_hit, rank FROM kw")
def keyword_search_and(spark, sf):
    return _big(S.keyword_topk(S.query_terms(bench_queries(spark, sf)), docs(spark, sf), K, "and"), "rank")


@query("keyword_search_or", f"WITH {QV}, {DOCS}, {kw_sql(K, 'or')} SELECT query_id, chunk_id, score, n_hit, rank FROM kw")
def keyword_search_or(spark, sf):
    return _big(S.keyword_topk(S.query_terms(bench_queries(spark, sf)), docs(spark, sf), K, "or"), "rank")


def _indexed(spark, sf, match):
    path = shared_dir(spark, "index")
    IX.write_index(docs(spark, sf), path, 32)
    return _big(IX.keyword_topk(spark, path, S.query_terms(bench_queries(spark, sf)), K, match, 32), "rank")


@query("keyword_index_or", f"WITH {QV}, {DOCS}, {kw_sql(K, 'or')} SELECT query_id, chunk_id, score, n_hit, rank FROM kw")
def keyword_index_or(spark, sf):
    """The same search from a stored index."""
    return _indexed(spark, sf, "or")


@query("keyword_index_and", f"WITH {QV}, {DOCS}, {kw_sql(K, 'and')} SELECT query_id, chunk_id, score, n_hit, rank FROM kw")
def keyword_index_and(spark, sf):
    return _indexed(spark, sf, "and")


@query("hybrid_rrf", f"WITH {QV}, {DOCS}, {sem_sql(2 * K)}, {kw_sql(2 * K, 'and')}, {fuse_sql(K)} SELECT query_id, chunk_id, semantic_rank, keyword_rank, rrf_score, rank, source AS file_name FROM fused JOIN cv USING (chunk_id)")
def hybrid_rrf(spark, sf):
    c = corpus(spark, sf)
    fused = S.hybrid_topk(bench_queries(spark, sf), docs(spark, sf), K, vectors=doc_vectors(spark, sf)).drop("search_type")
    return _big(fused.join(c.select("chunk_id", F.col("source").alias("file_name")), "chunk_id"), "rank", "semantic_rank", "keyword_rank")


@query("hybrid_weighted", f"WITH {QV}, {DOCS}, {sem_sql(2 * K, floor=0.2)}, {kw_sql(2 * K, 'or')}, {fuse_sql(K, ws=0.6, wk=0.4)} SELECT query_id, chunk_id, semantic_rank, keyword_rank, rrf_score, search_type, rank FROM fused")
def hybrid_weighted(spark, sf):
    out = S.hybrid_topk(bench_queries(spark, sf), docs(spark, sf), K, 0.2, 60, 0.6, 0.4, "or", doc_vectors(spark, sf))
    return _big(out, "rank", "semantic_rank", "keyword_rank")


_TRI = r"list_distinct(flatten(list_transform(list_distinct({t}), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def tri_sql(k, name="tri"):
    return f"""{name}_q AS (SELECT query_id, {_TRI.format(t=sql_tokens('text'))} AS g FROM qv), {name}_c AS (SELECT chunk_id, {_TRI.format(t=sql_tokens('text'))} AS g FROM cv),
{name}_qx AS (SELECT query_id, len(g) AS nq, unnest(g) AS t FROM {name}_q), {name}_cx AS (SELECT chunk_id, len(g) AS nc, unnest(g) AS t FROM {name}_c),
{name}_s AS (SELECT query_id, chunk_id, round(count(*) / (max(nq) + max(nc) - count(*)), 9) AS score FROM {name}_qx JOIN {name}_cx USING (t) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_s WHERE score >= 0.3) WHERE rank <= {k})"""


@query("near_duplicate_trigram", f"WITH {QV}, {DOCS}, {tri_sql(K)} SELECT query_id, chunk_id, score, rank FROM tri")
def near_duplicate_trigram(spark, sf):
    return _big(S.trigram_topk(bench_queries(spark, sf), docs(spark, sf), K), "rank")


@query("hybrid_left_trigram", f"""WITH {QV}, {DOCS}, {sem_sql(3 * K)}, {tri_sql(3 * K)},
b AS (SELECT s.query_id, s.chunk_id, s.rank AS semantic_rank, coalesce(t.rank, {3 * K + 1}) AS keyword_rank FROM sem s LEFT JOIN tri t ON s.query_id = t.query_id AND s.chunk_id = t.chunk_id),
f AS (SELECT *, round(0.7::DOUBLE / (60 + semantic_rank) + 0.3::DOUBLE / (60 + keyword_rank), 9) AS rrf_score FROM b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f) WHERE rank <= {K}""")
def hybrid_left_trigram(spark, sf):
    qs, c = bench_queries(spark, sf), corpus(spark, sf)
    out = S.fuse_left(S.semantic_topk(qs, c, 3 * K), S.trigram_topk(qs, docs(spark, sf), 3 * K), K)
    return _big(out, "rank", "semantic_rank", "keyword_rank")


@query("search_fallback", f"""WITH {QV}, {DOCS}, {sem_sql(K)}, {kw_sql(K, 'and')},
m AS (SELECT query_id, chunk_id, rank, 'keyword' AS source FROM kw UNION ALL SELECT query_id, chunk_id, rank, 'semantic' FROM sem WHERE query_id NOT IN (SELECT query_id FROM kw))
SELECT * FROM m""")
def search_fallback(spark, sf):
    qs, c = bench_queries(spark, sf), corpus(spark, sf)
    kw = S.keyword_topk(S.query_terms(qs), docs(spark, sf), K, "and").select("query_id", "chunk_id", "rank", F.lit("keyword").alias("source"))
    sem = S.semantic_topk(qs, c, K).select("query_id", "chunk_id", "rank", F.lit("semantic").alias("source"))
    return _big(S.with_fallback(kw, sem), "rank")


@query("multi_query_merge", f"""WITH {QV}, {DOCS}, {sem_sql(K)}, {kw_sql(K, 'or')}, {kw_sql(K, 'and', name='ka')},
u AS (SELECT query_id, chunk_id, rank FROM sem UNION ALL SELECT query_id, chunk_id, rank FROM kw UNION ALL SELECT query_id, chunk_id, rank FROM ka),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, count(*) AS n_lists FROM u GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f) WHERE rank <= {K}""")
def multi_query_merge(spark, sf):
    qs, c = bench_queries(spark, sf), corpus(spark, sf)
    terms = S.query_terms(qs)
    t = docs(spark, sf)
    return _big(S.merge_lists([S.semantic_topk(qs, c, K), S.keyword_topk(terms, t, K, "or"), S.keyword_topk(terms, t, K, "and")], K), "rank")


@query("semantic_cache", f"""WITH ev AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS ce FROM embeddings WHERE vec_id % 5 <> 0), {LC}, {sem_sql(1, 'lc', 'ev')}
SELECT query_id::BIGINT AS query_id, chunk_id, similarity FROM sem WHERE similarity >= 0.3""")
def semantic_cache(spark, sf):
    """Nearest logged query still valid; every fifth log entry has run out."""
    log = vectors(spark, sf).withColumn("expires_at", F.when(F.col("chunk_id") % 5 == 0, F.to_timestamp(F.lit("2024-01-01"))).otherwise(F.to_timestamp(F.lit("2024-03-01"))))
    return S.cached_answers(label_centres(spark, sf), log, F.to_timestamp(F.lit("2024-02-01")), 0.3).drop("rank")


@query("recency_ranked", f"""WITH {LC}, {EV}, {sem_sql(50, 'lc', 'ev')},
r AS (SELECT query_id::BIGINT AS query_id, chunk_id, round(0.7::DOUBLE * similarity + 0.3::DOUBLE * exp(-((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9) / 168), 6) AS score FROM sem JOIN events ON event_id = chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= {K}""")
def recency_ranked(spark, sf):
    hits = S.semantic_topk(label_centres(spark, sf), vectors(spark, sf), 50)
    made = table(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), F.col("ts").cast("timestamp").alias("made"))
    score = scoring.recency_weighted(F.col("similarity"), F.col("made"), F.to_timestamp(F.lit("2024-02-01")))
    out = hits.drop("rank").join(made, "chunk_id").select("query_id", "chunk_id", F.round(score, 6).alias("score"))
    return _big(top_k(out, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], K), "rank")


_TOPIC_WORDS = ["thon", "queaux", "the", "schen", "ción"]


@query("interest_boosted", f"""WITH {QV}, {DOCS}, {sem_sql(50)},
b AS (SELECT query_id, chunk_id, round(similarity * pow(1.5::DOUBLE, len(list_filter({sql_list(_TOPIC_WORDS)}, lambda w: contains(lower(text), w)))), 6) AS score FROM sem JOIN cv USING (chunk_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) WHERE rank <= {K}""")
def interest_boosted(spark, sf):
    c = corpus(spark, sf)
    hits = S.semantic_topk(bench_queries(spark, sf), c, 50).drop("rank").join(c.select("chunk_id", "text"), "chunk_id")
    score = scoring.interest_boost(F.col("similarity"), F.col("text"), F.array(*[F.lit(w) for w in _TOPIC_WORDS]))
    out = hits.select("query_id", "chunk_id", F.round(score, 6).alias("score"))
    return _big(top_k(out, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], K), "rank")


_RR_TERMS = rf"list_filter(regexp_split_to_array(lower(qtext), '[^A-Za-z0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(vocab.RERANK_STOP_WORDS)}, w))"


@query("keyword_rerank", f"""WITH {QV}, {DOCS}, {sem_sql(50)},
c AS (SELECT s.query_id, s.chunk_id, s.rank AS original_rank, q.text AS qtext, lower(source || ' ' || lang || ' ' || cv.text) AS body FROM sem s JOIN qv q USING (query_id) JOIN cv USING (chunk_id)),
d AS (SELECT *, {_RR_TERMS} AS terms, regexp_split_to_array(body, '[^A-Za-z0-9_]+') AS words FROM c),
s AS (SELECT query_id, chunk_id, original_rank, round(coalesce(list_sum(list_transform(terms, lambda t: len(list_filter(words, lambda w: w = t)))), 0) / sqrt(length(body)), 9) AS score FROM d)
SELECT query_id, chunk_id, original_rank, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM s) WHERE rank <= 5""")
def keyword_rerank(spark, sf):
    return _big(_reranked(spark, sf, 5), "original_rank", "rank")


def _reranked(spark, sf, k):
    c, qs = corpus(spark, sf), bench_queries(spark, sf)
    hits = S.semantic_topk(qs, c, 50).withColumnRenamed("rank", "original_rank").drop("similarity")
    rows = hits.join(c.select("chunk_id", F.col("source").alias("title"), F.col("lang").alias("section_path"), F.col("text").alias("content")), "chunk_id") \
        .join(qs.select("query_id", F.col("text").alias("question")), "query_id")
    return R.keyword_rerank(rows, k).select("query_id", "chunk_id", "original_rank", "score", "rank")


@query("rerank_or_pass", f"""WITH {QV}, {DOCS}, {sem_sql(15, floor=0.25)}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM sem),
s AS (SELECT query_id, chunk_id, rank AS original_rank, CASE WHEN n <= 5 THEN round(1 - (rank - 1) * 0.1::DOUBLE, 6) ELSE round(similarity, 6) END AS score, n FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM s WHERE n <= 5 OR score >= 0.3)
SELECT query_id, chunk_id, original_rank, score, rank FROM r WHERE rank <= 5""")
def rerank_or_pass(spark, sf):
    hits = S.semantic_topk(bench_queries(spark, sf), corpus(spark, sf), 15, 0.25).withColumnRenamed("rank", "original_rank")
    scored = hits.withColumn("model_score", F.round("similarity", 6))
    return _big(R.rerank_or_pass(scored, "model_score", 5, 0.3).select("query_id", "chunk_id", "original_rank", F.round("score", 6).alias("score"), "rank"), "original_rank", "rank")


@query("doc_search_ilike", """WITH d AS (SELECT source AS document_id, doc_id // 20 AS page_number, doc_id AS chunk_index, text FROM documents)
SELECT document_id, chunk_index, page_number, rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS LAST, chunk_index) AS rank FROM d WHERE text ILIKE '%th_re%') WHERE rank <= 50""")
def doc_search_ilike(spark, sf):
    d = texts(spark, sf, "documents").select(F.col("source").alias("document_id"), F.floor(F.col("doc_id") / 20).alias("page_number"), F.col("doc_id").alias("chunk_index"), "text")
    return _big(R.find_in_documents(d, "th_re", 50).select("document_id", "chunk_index", "page_number", "rank"), "rank")
