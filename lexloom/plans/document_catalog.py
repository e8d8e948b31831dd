"""Catalogue: files, pages, chunks, corpus numbers, context."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import vocab
from lexloom.functions import text as T
from lexloom.operators import chunking as C, context as X, passages as PG, prefilter as P, search as S, tables as TB
from lexloom.plans.common import QUESTIONS_SQL, q, query, questions, sql_list, table, texts
from lexloom.plans.search_catalog import DOCS, QV, _big, bench_queries, corpus, docs, kw_sql, sem_sql
from lexloom.sources import files as FS


def documents(spark, sf):
    return texts(spark, sf, "documents")


CHUNKS = """chunks AS (SELECT doc_id, unnest(range(0, greatest(1, ceil((length(text) - 150) / 850.0)::BIGINT))) AS chunk_index, text FROM documents WHERE length(text) > 0),
chunk AS (SELECT doc_id, chunk_index, chunk_index * 850 AS start, substring(text, chunk_index * 850 + 1, 1000) AS content FROM chunks)"""


@query("chunk_fixed", f"WITH {CHUNKS} SELECT doc_id, chunk_index, start, md5(content) AS digest, length(content) AS n_chars FROM chunk")
def chunk_fixed(spark, sf):
    d = C.fixed_chunks(documents(spark, sf).select("doc_id", "text"), "text")
    return d.select("doc_id", "chunk_index", "start", F.md5("content").alias("digest"), F.length("content").cast("bigint").alias("n_chars"))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    d = documents(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")
    parts = C.recursive_chunks(d, ["document_id", "page_number"], "text")
    return C.number_chunks(parts, "document_id", "page_number", "pos").drop("pos")


@query("chunk_recursive_cover", """SELECT doc_id, md5(regexp_replace(text, '[\\x{1c}-\\x{1f}\\s\\p{Z}\\x{85}]+', '', 'g')) AS digest, true AS fits FROM documents WHERE length(trim(text)) > 0""")
def chunk_recursive_cover(spark, sf):
    """Without overlap the chunks hold every non-blank character once, in order, and none is longer than asked."""
    d = documents(spark, sf).select("doc_id", "text")
    parts = C.recursive_chunks(d, ["doc_id"], "text", 1000, 0)
    bare = F.regexp_replace("content", r"[\x1c-\x1f\s\p{Z}\x85]+", "")
    # the chunks of one text
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", bare.alias("c")))).alias("r"), F.max(F.length("content")).alias("longest"))
    return rows.select("doc_id", F.md5(F.array_join(F.transform("r", lambda x: x["c"]), "")).alias("digest"), (F.col("longest") <= 1000).alias("fits"))


@query("chunk_index_global", f"""WITH {CHUNKS} SELECT source AS document_id, c.doc_id AS page_number, row_number() OVER (PARTITION BY source ORDER BY c.doc_id, c.chunk_index) - 1 AS chunk_index, md5(content) AS digest
FROM chunk c JOIN documents d ON c.doc_id = d.doc_id""")
def chunk_index_global(spark, sf):
    d = documents(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), "text")
    parts = C.fixed_chunks(d, "text").withColumnRenamed("chunk_index", "pos").select("document_id", "page_number", "pos", F.md5("content").alias("digest"))
    return C.number_chunks(parts, "document_id", "page_number", "pos").drop("pos")


@query("html_to_text", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{00a0}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages""")
def html_to_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("corpus_stats", f"""WITH {CHUNKS}, c AS (SELECT count(*) AS n_chunks, avg(length(content)) AS avg_chunk, sum(length(content)) AS chunk_chars FROM chunk),
d AS (SELECT count(*) AS n_pages, count(*) FILTER (WHERE trim(text) <> '') AS n_with_text, sum(length(text)) AS chars, sum(ceil(length(text) / 4)) AS tokens FROM documents)
SELECT n_pages, n_with_text, chars::BIGINT AS chars, tokens::BIGINT AS tokens, n_chunks, round(avg_chunk, 6) AS avg_chunk, round(tokens * 0.02 / 1000000, 9) AS embedding_cost FROM c, d""")
def corpus_stats(spark, sf):
    d = documents(spark, sf)
    return TB.corpus_stats(d.select("doc_id", "text"), C.fixed_chunks(d.select("doc_id", "text"), "text"))


@query("document_filter", """SELECT doc_id, lang, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS snippet, substring(text, 1, 1000) AS preview
FROM documents WHERE contains(lower(source), 'c1') AND lang IN ('en', 'fr')""")
def document_filter(spark, sf):
    d = TB.name_contains(documents(spark, sf), "source", "C1")
    d = TB.optional_types(d, "lang", ["en", "fr"])
    return d.select("doc_id", "lang", T.preview(F.col("text"), 500).alias("snippet"), T.preview(F.col("text"), 1000, False).alias("preview"))


@query("neighbour_expand", f"""WITH {QV}, {DOCS}, {sem_sql(10)}, r AS (SELECT query_id, rank, source AS document_id, chunk_id // 20 AS chunk_index, cv.text FROM sem JOIN cv USING (chunk_id)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, chunk_index // 4 ORDER BY rank) AS n FROM r) WHERE n = 1)
SELECT query_id, rank, k.document_id, chunk_index, md5(string_agg(d.text, chr(10) || chr(10) ORDER BY d.doc_id // 20)) AS digest
FROM k JOIN documents d ON d.source = k.document_id AND d.doc_id // 20 BETWEEN chunk_index - 2 AND chunk_index + 2 GROUP BY 1, 2, 3, 4""")
def neighbour_expand(spark, sf):
    c = corpus(spark, sf)
    place = F.floor(F.col("chunk_id") / 20)
    hits = S.semantic_topk(bench_queries(spark, sf), c, 10).join(c.select("chunk_id", "text", "source"), "chunk_id")
    hits = hits.select("query_id", "rank", F.col("source").alias("document_id"), F.col("source").alias("file_name"), place.alias("chunk_index"), F.col("text").alias("content"))
    chunks = c.select(F.col("source").alias("document_id"), place.alias("chunk_index"), F.col("text").alias("content"))
    out = S.expand_neighbours(hits, chunks)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "document_id", "chunk_index", F.md5("content").alias("digest"))


_BLOCK = "'[' || rank || '] ' || source || ' (Pages ' || chunk_id || '-' || (chunk_id + 1) || ')' || chr(10) || cv.text"


@query("context_block", f"""WITH {QV}, {DOCS}, {sem_sql(5)} SELECT query_id, md5(string_agg({_BLOCK}, chr(10) || chr(10) || repeat('=', 80) || chr(10) || chr(10) ORDER BY rank)) AS digest, sum(length({_BLOCK}))::BIGINT + (count(*) - 1) * 84 AS n_chars
FROM sem JOIN cv USING (chunk_id) GROUP BY 1""")
def context_block(spark, sf):
    c = corpus(spark, sf)
    hits = S.semantic_topk(bench_queries(spark, sf), c, 5).join(c.select("chunk_id", "text", "source"), "chunk_id")
    hits = hits.select("query_id", "rank", F.col("source").alias("section_path"), F.col("chunk_id").alias("page_start"), (F.col("chunk_id") + 1).alias("page_end"),
                       F.col("text").alias("content"), F.lit(None).cast("string").alias("summary"))
    return X.context_blocks(hits).select("query_id", F.md5("context").alias("digest"), F.length("context").cast("bigint").alias("n_chars"))


@query("sources_by_file", f"""WITH {QV}, {DOCS}, {sem_sql(15)}, t AS (SELECT query_id, CASE WHEN rank <= 5 THEN 'top' ELSE 'other' END AS tier, source AS file_name, rank, similarity FROM sem JOIN cv USING (chunk_id)),
g AS (SELECT query_id, tier, file_name, min(rank) AS f, count(*) AS n_sources, max(similarity) AS best FROM t GROUP BY 1, 2, 3)
SELECT query_id, tier, file_name, n_sources, best, row_number() OVER (PARTITION BY query_id, tier ORDER BY f) AS file_pos FROM g""")
def sources_by_file(spark, sf):
    c = corpus(spark, sf)
    hits = S.semantic_topk(bench_queries(spark, sf), c, 15).join(c.select("chunk_id", F.col("source").alias("file_name")), "chunk_id")
    out = X.tiered_sources(hits.select("query_id", "file_name", "similarity", F.col("rank").alias("pos")), 15)
    return out.withColumn("file_pos", F.col("file_pos").cast("bigint"))


_NAMES = "CASE WHEN doc_id % 50 = 7 THEN 'Federal-Decree-Law-' || doc_id || '.pdf' WHEN doc_id % 50 = 11 THEN 'Executive Regulation ' || doc_id WHEN doc_id % 50 = 13 THEN 'Corporate Tax General Guide ' || doc_id WHEN doc_id % 50 = 17 THEN 'transfer-pricing guide ' || doc_id ELSE source || ' ' || lang END"


def _named(spark, sf):
    i = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 50
    name = F.when(m == 7, F.concat(F.lit("Federal-Decree-Law-"), i, F.lit(".pdf"))).when(m == 11, F.concat(F.lit("Executive Regulation "), i)) \
        .when(m == 13, F.concat(F.lit("Corporate Tax General Guide "), i)).when(m == 17, F.concat(F.lit("transfer-pricing guide "), i)) \
        .otherwise(F.concat("source", F.lit(" "), "lang"))
    return documents(spark, sf).select(F.col("lang").alias("owner"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("pos"), name.alias("name"), F.col("text").alias("description"))


_PT = rf"list_filter(regexp_split_to_array(lower(question), '[\s\x{{00a0}}]+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(vocab.PREFILTER_STOP_WORDS)}, w))"
_PH = " + ".join(
    f"CASE WHEN contains(lower(question), {q(p)}) THEN (CASE WHEN " + " OR ".join(f"contains(lower(name), {q(f)})" for f in sorted({p, p.replace(' ', '-', 1), p.replace(' ', '_', 1)}))
    + f" THEN 20 ELSE 0 END) + (CASE WHEN contains(low, {q(p)}) THEN 15 ELSE 0 END) ELSE 0 END" for p in vocab.PREFILTER_PHRASES)
_CORE = "(contains(lower(name), 'federal-decree-law') OR (contains(lower(name), 'corporate tax') AND contains(lower(name), 'general')))"

# questions about documents: every benchmark text, and the distinct order questions
_PQ = f"""{QUESTIONS_SQL}, pq AS (SELECT ['en', 'fr', 'de', 'es'][(item_id % 4 + 1)::INT] AS owner, 'b' || item_id AS query_id, text AS question FROM benchmark
UNION ALL SELECT ['en', 'fr', 'de', 'es'][(min(question_id) % 4 + 1)::INT], 'q' || min(question_id), question FROM questions GROUP BY question)"""


def prefilter_questions(spark, sf):
    owner = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (n % 4 + 1).cast("int"))
    b = table(spark, sf, "benchmark").select(owner(F.col("item_id")).alias("owner"), F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.col("text").alias("question"))
    o = questions(spark, sf).groupBy("question").agg(F.min("question_id").alias("i")).select(owner(F.col("i")).alias("owner"), F.concat(F.lit("q"), F.col("i")).alias("query_id"), "question")
    return b.unionByName(o)


@query("doc_prefilter", f"""WITH {_PQ}, nd AS (SELECT lang AS owner, doc_id, lower(text) AS low, {_NAMES} AS name FROM documents),
p AS (SELECT owner, query_id, question, {_PT} AS terms, regexp_matches(lower(question), 'article\\s*\\d+') AS art FROM pq),
sc AS (SELECT query_id, doc_id, art, coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(name), t) THEN 10 ELSE 0 END + CASE WHEN contains(low, t) THEN 5 ELSE 0 END)), 0) + {_PH}
  + CASE WHEN {_CORE} AND art THEN 50 WHEN {_CORE} THEN 5 ELSE 0 END + CASE WHEN art AND contains(lower(name), 'executive regulation') THEN 30 ELSE 0 END AS score FROM p JOIN nd USING (owner)),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10),
law AS (SELECT owner, doc_id FROM nd WHERE contains(lower(name), 'federal-decree-law') OR contains(lower(name), 'executive regulation')),
hv AS (SELECT p.query_id, p.owner, p.art, count(ch.doc_id) AS have FROM p LEFT JOIN ch ON ch.query_id = p.query_id GROUP BY 1, 2, 3),
tu AS (SELECT query_id, doc_id, have + n AS rank FROM (SELECT hv.query_id, law.doc_id, have, row_number() OVER (PARTITION BY hv.query_id ORDER BY law.doc_id) AS n FROM hv JOIN law USING (owner)
  WHERE art AND have < 3 AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.query_id = hv.query_id AND ch.doc_id = law.doc_id)) WHERE have + n <= 10),
al AS (SELECT query_id, doc_id, score, rank FROM ch UNION ALL SELECT query_id, doc_id, 0, rank FROM tu),
fb AS (SELECT * FROM (SELECT owner, doc_id, row_number() OVER (PARTITION BY owner ORDER BY doc_id) AS rank FROM nd WHERE contains(lower(name), 'corporate tax') OR contains(lower(name), 'federal-decree-law')) WHERE rank <= 5),
fd AS (SELECT * FROM (SELECT owner, doc_id, row_number() OVER (PARTITION BY owner ORDER BY doc_id) AS rank FROM nd WHERE owner NOT IN (SELECT owner FROM fb)) WHERE rank <= 10),
fin AS (SELECT * FROM al UNION ALL SELECT query_id, doc_id, 0, rank FROM p JOIN (SELECT * FROM fb UNION ALL SELECT * FROM fd) USING (owner) WHERE query_id NOT IN (SELECT query_id FROM al))
SELECT query_id, doc_id AS document_id, score::BIGINT AS score, rank::BIGINT AS rank FROM fin""")
def doc_prefilter(spark, sf):
    return P.prefilter_documents(prefilter_questions(spark, sf), _named(spark, sf), 10)


# every order asks, in the language of its customer; equal questions of one language have equal answers
_AQ = f"""{QUESTIONS_SQL}, aq AS (SELECT ['en', 'fr', 'de', 'es'][(owner % 4 + 1)::INT] AS owner, question_id AS query_id, question FROM questions), pq AS (SELECT DISTINCT owner, question FROM aq)"""
_MAIN = "(contains(lower(name), 'federal-decree-law-no.-47') OR contains(lower(name), 'federal decree-law'))"


def all_questions(spark, sf):
    owner = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("owner") % 4 + 1).cast("int"))
    return questions(spark, sf).select(owner.alias("owner"), F.col("question_id").alias("query_id"), "question")


@query("doc_prefilter_scores", f"""WITH {_AQ}, nd AS (SELECT lang AS owner, doc_id, lower(coalesce(text, '')) AS low, {_NAMES} AS name FROM documents),
p AS (SELECT owner, question, {_PT} AS terms FROM pq),
sc AS (SELECT owner, question, doc_id, coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(name), t) THEN 10 ELSE 0 END + CASE WHEN contains(low, t) THEN 5 ELSE 0 END)), 0) + {_PH}
  + CASE WHEN {_MAIN} THEN 5 ELSE 0 END AS score FROM p JOIN nd USING (owner)),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, question ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)
SELECT query_id, doc_id AS document_id, score::BIGINT AS score, rank::BIGINT AS rank FROM aq JOIN ch USING (owner, question)""")
def doc_prefilter_scores(spark, sf):
    """The best ten documents of every order's question, also where none has points."""
    return P.scored_documents(all_questions(spark, sf), _named(spark, sf), 10)


@query("doc_prefilter_all", f"""WITH {_AQ}, nd AS (SELECT lang AS owner, doc_id, lower(coalesce(text, '')) AS low, {_NAMES} AS name FROM documents),
p AS (SELECT owner, question, {_PT} AS terms, regexp_matches(lower(question), 'article\\s*\\d+') AS art FROM pq),
sc AS (SELECT owner, question, doc_id, art, coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(name), t) THEN 10 ELSE 0 END + CASE WHEN contains(low, t) THEN 5 ELSE 0 END)), 0) + {_PH}
  + CASE WHEN {_CORE} AND art THEN 50 WHEN {_CORE} THEN 5 ELSE 0 END + CASE WHEN art AND contains(lower(name), 'executive regulation') THEN 30 ELSE 0 END AS score FROM p JOIN nd USING (owner)),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, question ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10),
law AS (SELECT owner, doc_id FROM nd WHERE contains(lower(name), 'federal-decree-law') OR contains(lower(name), 'executive regulation')),
hv AS (SELECT p.owner, p.question, p.art, count(ch.doc_id) AS have FROM p LEFT JOIN ch USING (owner, question) GROUP BY 1, 2, 3),
tu AS (SELECT owner, question, doc_id, have + n AS rank FROM (SELECT hv.owner, hv.question, law.doc_id, have, row_number() OVER (PARTITION BY hv.owner, hv.question ORDER BY law.doc_id) AS n FROM hv JOIN law USING (owner)
  WHERE art AND have < 3 AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.owner = hv.owner AND ch.question = hv.question AND ch.doc_id = law.doc_id)) WHERE have + n <= 10),
al AS (SELECT owner, question, doc_id, score, rank FROM ch UNION ALL SELECT owner, question, doc_id, 0, rank FROM tu),
fb AS (SELECT * FROM (SELECT owner, doc_id, row_number() OVER (PARTITION BY owner ORDER BY doc_id) AS rank FROM nd WHERE contains(lower(name), 'corporate tax') OR contains(lower(name), 'federal-decree-law')) WHERE rank <= 5),
fd AS (SELECT * FROM (SELECT owner, doc_id, row_number() OVER (PARTITION BY owner ORDER BY doc_id) AS rank FROM nd WHERE owner NOT IN (SELECT owner FROM fb)) WHERE rank <= 10),
none AS (SELECT owner, question FROM p EXCEPT SELECT owner, question FROM al),
fin AS (SELECT * FROM al UNION ALL SELECT owner, question, doc_id, 0, rank FROM none JOIN (SELECT * FROM fb UNION ALL SELECT * FROM fd) USING (owner))
SELECT query_id, doc_id AS document_id, score::BIGINT AS score, rank::BIGINT AS rank FROM aq JOIN fin USING (owner, question)""")
def doc_prefilter_all(spark, sf):
    """Documents for the question of every order, with top-ups and fallbacks."""
    return P.prefilter_documents(all_questions(spark, sf), _named(spark, sf), 10)


@query("page_grouping", """WITH RECURSIVE p AS (SELECT *, sum(t) OVER (PARTITION BY document_id ORDER BY i) AS s FROM (
  SELECT source AS document_id, doc_id AS page_number, ceil(length(text) / 4)::BIGINT AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)),
b AS (SELECT document_id, CASE WHEN sum(t) <= 5000 THEN sum(t) ELSE ceil((sum(t) / ceil(sum(t) / 5000) + 5000) / 2) END AS budget FROM p GROUP BY 1),
jump AS (SELECT a.document_id, a.i, min(q.i) AS j FROM p a JOIN b USING (document_id) LEFT JOIN p r ON r.document_id = a.document_id AND r.i = a.i - 1
  JOIN p q ON q.document_id = a.document_id AND q.i > a.i AND q.s > coalesce(r.s - r.t, 0) + b.budget GROUP BY 1, 2),
g(document_id, group_no, i) AS (SELECT document_id, 0::BIGINT, 0::BIGINT FROM b UNION ALL SELECT g.document_id, group_no + 1, jump.j FROM g JOIN jump USING (document_id, i)),
spans AS (SELECT *, lead(i) OVER (PARTITION BY document_id ORDER BY group_no) AS stop FROM g)
SELECT p.document_id, page_number, group_no FROM p JOIN spans s ON s.document_id = p.document_id AND p.i >= s.i AND (s.stop IS NULL OR p.i < s.stop)
UNION ALL SELECT p.document_id, page_number, group_no FROM p JOIN g ON g.document_id = p.document_id AND group_no > 0 AND p.i = g.i - 1""")
def page_grouping(spark, sf):
    d = documents(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), T.estimate_tokens(F.col("text")).alias("token_count"))
    return C.pages_of_groups(d, "document_id", "page_number", "token_count", 5000)


@query("legal_headers", f"""WITH {QUESTIONS_SQL} SELECT question_id,
  nullif(regexp_extract(question, '(?i)Article\\s+\\(?(\\d+)\\)?', 1), '') AS article, nullif(regexp_extract(question, '(?i)Chapter\\s+\\(?(\\d+)\\)?', 1), '') AS chapter,
  nullif(regexp_extract(question, '(?i)(?:Clause|Section)\\s+(\\d+(?:\\.\\d+)*)', 1), '') AS clause,
  concat_ws(' > ', 'Law ' || owner, 'Article ' || nullif(regexp_extract(question, '(?i)Article\\s+\\(?(\\d+)\\)?', 1), ''), 'Section ' || nullif(regexp_extract(question, '(?i)(?:Clause|Section)\\s+(\\d+(?:\\.\\d+)*)', 1), '')) || chr(10) || chr(10) || question AS content
FROM questions""")
def legal_headers(spark, sf):
    d = questions(spark, sf).withColumn("title", F.concat(F.lit("Law "), F.col("owner")))
    d = C.with_context_header(d, "title", "question").withColumn("s", T.legal_structure(F.col("question")))
    return d.select("question_id", F.col("s.article_number").alias("article"), F.col("s.chapter_number").alias("chapter"), F.col("s.clause_number").alias("clause"),
                    F.col("content_with_context").alias("content"))


@query("section_titles", """WITH e AS (SELECT source AS document_id, doc_id AS pos, CASE WHEN n_chars < 400 THEN text END AS title FROM documents)
SELECT document_id, pos, md5(last_value(title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos)) AS section FROM e""")
def section_titles(spark, sf):
    d = documents(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("pos"), "text", "n_chars")
    out = C.carry_section_titles(d, "document_id", ["pos"], F.col("n_chars") < 400, "text", F.floor(F.col("pos") / 256))
    return out.select("document_id", "pos", F.md5("section_title").alias("section"))


@query("semantic_segments", """WITH s AS (SELECT source AS document_id, doc_id AS pos, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id),
d AS (SELECT *, round(1 - list_cosine_similarity(v, lag(v) OVER (PARTITION BY document_id ORDER BY pos)), 9) AS dist FROM s),
c AS (SELECT document_id, quantile_cont(dist, 0.9) AS cut FROM d GROUP BY 1)
SELECT document_id, pos, dist AS distance, sum(CASE WHEN dist > cut THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos)::BIGINT AS segment FROM d JOIN c USING (document_id)""")
def semantic_segments(spark, sf):
    d = documents(spark, sf).select("source", "doc_id").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    s = d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("pos"), "embedding")
    return C.semantic_breaks(s, "document_id", "pos", "embedding", 0.9, F.floor(F.col("pos") / 256)).select("document_id", "pos", "distance", "segment")


_NORM = r"lower(regexp_replace(regexp_replace(regexp_replace({t}, '[\s\x{{00a0}}]+', ' ', 'g'), '[^A-Za-z0-9_\s]', '', 'g'), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'))"


@query("locate_passages", f"""WITH {QV}, {DOCS}, {kw_sql(10, 'and')},
n AS (SELECT query_id, chunk_id, {_NORM.format(t='cv.text')} AS page, substring({_NORM.format(t='qv.text')}, 1, 300) AS target FROM kw JOIN cv USING (chunk_id) JOIN qv USING (query_id))
SELECT query_id, chunk_id, (instr(page, target) - 1)::BIGINT AS start, length(target)::BIGINT AS len FROM n WHERE instr(page, target) > 0""")
def locate_passages(spark, sf):
    """Benchmark texts in all documents holding all their words, where they stand there whole."""
    c, qs = corpus(spark, sf), bench_queries(spark, sf)
    hits = S.keyword_matches(S.query_terms(qs), docs(spark, sf))
    rows = hits.join(c.select("chunk_id", F.col("text").alias("page")), "chunk_id").join(qs.select("query_id", F.col("text").alias("passage")), "query_id")
    d = rows.withColumn("l", T.locate_passage(F.col("passage"), F.col("page"))).where(F.col("l.strategy") == "full")
    return d.select("query_id", "chunk_id", F.col("l.start").cast("bigint").alias("start"), F.col("l.len").cast("bigint").alias("len"))


_STRIPPED = (r"regexp_replace(regexp_replace(regexp_replace({t}, '^(i{{1,3}}|iv|v|vi{{0,3}}|ix|x{{1,3}}|[a-z]|[0-9]+)\s+', '', 'i'), '^[\d.)\]]+\s*', ''), "
             r"'^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')")
#: (strategy, phrase, length, condition), strict to lenient
_PLACES = [
    ("full", "target", "length(target)", "true"), ("head150", "substring(target, 1, 150)", "least(150, length(target))", "true"),
    ("head80", "substring(target, 1, 80)", "least(80, length(target))", "true"), ("head40", "substring(target, 1, 40)", "least(3 * least(40, length(target)), length(target))", "true"),
    ("key_phrase", "key", "least(2 * length(key), 200)", "length(key) > 20"), ("clean200", "substring(clean, 1, 200)", "least(200, length(clean))", "clean <> target"),
    ("clean80", "substring(clean, 1, 80)", "least(2 * least(80, length(clean)), 150)", "clean <> target"),
    ("clean40", "substring(clean, 1, 40)", "least(3 * least(40, length(clean)), 150)", "clean <> target"),
    ("middle", "array_to_string(words[6:15], ' ')", "least(2 * length(array_to_string(words[6:15], ' ')), 200)", "len(words) > 10 AND length(array_to_string(words[6:15], ' ')) > 30"),
    *[("word_run", f"array_to_string(solid[{i}:{i + 3}], ' ')", f"least(3 * length(array_to_string(solid[{i}:{i + 3}], ' ')), 150)",
       f"len(solid) - 3 >= {i} AND length(array_to_string(solid[{i}:{i + 3}], ' ')) > 15") for i in range(1, 11)],
    ("calc", "substring(calc, 1, 60)", "least(2 * least(60, length(calc)), 150)", "length(calc) > 30"),
    *[("distinctive", q(p), "NULL", f"contains(clean, {q(p)})") for p in vocab.DISTINCTIVE_PHRASES],
]
_PLACE_ROWS = " UNION ALL ".join(
    f"SELECT query_id, {i} AS step, '{name}' AS strategy, {phrase} AS phrase, ({length})::BIGINT AS n FROM parts WHERE {ok}" for i, (name, phrase, length, ok) in enumerate(_PLACES))


@query("passage_places", rf"""WITH passages AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL
    SELECT 1000000 + item_id, (item_id % 9 + 1)::VARCHAR || ') ' || substring(text, item_id % 60 + 1, 45) || ' tail cut off by hand' FROM benchmark UNION ALL
    SELECT 2000000 + item_id, 'Lead words that no page has: ' || substring(text, item_id % 20 + 8) FROM benchmark),
t AS (SELECT query_id, substring({_NORM.format(t='text')}, 1, 300) AS target FROM passages), c AS (SELECT *, {_STRIPPED.format(t='target')} AS clean FROM t WHERE target <> ''),
parts AS (SELECT *, string_split(clean, ' ') AS words, list_filter(string_split(clean, ' '), lambda w: length(w) > 3) AS solid,
  array_to_string(list_filter(string_split(target, ' '), lambda w: length(w) > 4)[1:5], ' ') AS key,
  regexp_replace(regexp_replace(regexp_replace(clean, '^[\d\s%x=aed.,()+-]+', '', 'i'), '^(the\s+)?portion\s+of\s+', '', 'i'), '^\s+|\s+$', '', 'g') AS calc FROM c),
phrases AS ({_PLACE_ROWS}), pages AS (SELECT doc_id AS chunk_id, {_NORM.format(t='text')} AS page FROM documents),
hits AS (SELECT query_id, chunk_id, step, strategy, instr(page, phrase) - 1 AS start, coalesce(n, least(100, length(page) - instr(page, phrase) + 1)) AS len
  FROM phrases, pages WHERE phrase <> '' AND contains(page, phrase))
SELECT query_id, chunk_id, start::BIGINT AS start, len::BIGINT AS len, strategy FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY step) = 1""")
def passage_places(spark, sf):
    """Where every benchmark text stands in all documents, whole, cut and with foreign words before it, by any attempt."""
    b = table(spark, sf, "benchmark")
    n, text = F.col("item_id"), F.col("text")
    forms = [(0, text), (1_000_000, F.concat((n % 9 + 1).cast("string"), F.lit(") "), F.substring(text, n % 60 + 1, F.lit(45)), F.lit(" tail cut off by hand"))),
             (2_000_000, F.concat(F.lit("Lead words that no page has: "), F.substring(text, n % 20 + 8, F.length(text))))]
    passages = b.select(F.explode(F.array(*[F.struct((n + k).alias("query_id"), t.alias("text")) for k, t in forms])).alias("p")).select("p.*")
    return _big(PG.locate_passages(passages, docs(spark, sf)), "start", "len")


_HIT = "instr(lower(text), 'the')"


@query("match_snippets", f"""SELECT doc_id, CASE WHEN {_HIT} = 0 THEN CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END ELSE
  CASE WHEN greatest(1, {_HIT} - 50) > 1 THEN '...' ELSE '' END || substring(text, greatest(1, {_HIT} - 50), least(length(text), {_HIT} + 2 + 50) - greatest(1, {_HIT} - 50) + 1)
  || CASE WHEN least(length(text), {_HIT} + 2 + 50) < length(text) THEN '...' ELSE '' END END AS snippet,
  len(regexp_extract_all(CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END, '(?i)the'))::BIGINT AS n_marked FROM documents""")
def match_snippets(spark, sf):
    parts = T.match_parts(F.col("text"), F.lit("the"))
    return documents(spark, sf).select("doc_id", T.match_snippet(F.col("text"), F.lit("the")).alias("snippet"),
                                       F.size(F.filter(parts, lambda p: p["is_match"])).cast("bigint").alias("n_marked"))


@query("page_extraction", r"""SELECT url AS path, 1::BIGINT AS page_number, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{00a0}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages""")
def page_extraction(spark, sf):
    """Stored pages taken through the file extractor as HTML files."""
    raw = texts(spark, sf, "pages").select(F.col("url").alias("path"), F.lit("text/html").alias("mime_type"), F.encode("html", "UTF-8").alias("content"), F.length("html").cast("bigint").alias("length"))
    ok, _ = FS.split_supported(raw)
    return FS.extract_pages(ok).select("path", F.col("page_number").cast("bigint").alias("page_number"), "text")
