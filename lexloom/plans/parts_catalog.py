"""Catalogue: model calls with stand-in clients, model replies, tags and templates, stored
tables read back, SQL functions, and the remaining evaluation reports.

Texts come from benchmark, conversations and documents. A stand-in client works out its reply
from the prompt, so SQL can say what it will be.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lexloom.functions import query as QF, sql as FS, text as T
from lexloom.operators import context as X, evaluation as E, infer, rerank as RR, search as S, tree as R
from lexloom.plans.common import query, sql_tokens, table, texts
from lexloom.plans.search_catalog import DOCS, EV, LC, QV, _big, bench_queries, corpus, label_centres, sem_sql, vectors
from lexloom.plans.tree_catalog import PAGES, TREE, nodes, pages
from lexloom.session import checkpoint, shared_dir
from lexloom.sources import questions as QS, sinks


# ------------------------------------------------------------------ model calls

def _length_client():
    """Rates a prompt by its length; says nothing on every eleventh, and has no number for every seventh."""
    return lambda prompts: [None if len(p) % 11 == 0 else "none" if len(p) % 7 == 0 else f" {len(p) % 130 - 10} points" for p in prompts]


@query("model_ratings", """WITH p AS (SELECT conv_id, turn, role, text, 'Rate ' || coalesce(role, '') || ' from 0 to 100: ' || coalesce(text, '') AS prompt FROM conversations),
r AS (SELECT *, CASE WHEN length(prompt) % 11 = 0 THEN NULL WHEN length(prompt) % 7 = 0 THEN 'none' ELSE ' ' || (length(prompt) % 130 - 10) || ' points' END AS reply FROM p)
SELECT conv_id, turn, md5(prompt) AS prompt_md5, reply, greatest(0, least(100, coalesce(try_cast(nullif(regexp_extract(reply, '^\\s*([+-]?\\d+)', 1), '') AS INTEGER), 50)))::BIGINT AS score FROM r""")
def model_ratings(spark, sf):
    """Every conversation turn put into a template, sent to a client, and its reply read as a score."""
    c = texts(spark, sf, "conversations")
    prompts = c.select("conv_id", "turn", infer.fill_template("Rate {role} from 0 to 100: {text}", role=F.col("role"), text=F.col("text")).alias("prompt"))
    replied = infer.batch_infer(prompts, "prompt", "reply", _length_client)
    return replied.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), "reply", infer.judge_score(F.col("reply")).cast("bigint").alias("score"))


def _no_model():
    raise RuntimeError("no such model")


def _counting_model():
    return lambda batch: [[float(len(t)), float(t.count(" ")), 1.0] for t in batch]


@query("embed_providers", """SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN 'counts' END AS provider,
CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN length(text) + length(text) - length(replace(text, ' ', '')) + 1 END::DOUBLE AS total FROM documents""")
def embed_providers(spark, sf):
    """The first provider fails, so the second one's name and vectors stand in every row."""
    d = table(spark, sf, "documents").select("doc_id", infer.embed(F.col("text"), [("absent", _no_model), ("counts", _counting_model)]).alias("e"))
    return d.select("doc_id", "e.provider", F.aggregate(F.transform("e.vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x).alias("total"))


def _question_client():
    return lambda prompts: ['Here they are: ["What of ' + str(len(p)) + '?", "Why?"] Good luck' if len(p) % 5 else "no list" for p in prompts]


@query("synthetic_questions", """WITH k AS (SELECT source AS document_id, doc_id AS chunk_index, length('Ask about: ' || coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
SELECT document_id, chunk_index, unnest(['What of ' || n || '?', 'Why?']) AS question FROM k WHERE r <= 5 AND n % 5 <> 0""")
def synthetic_questions(spark, sf):
    """Questions a client writes for the first five chunks of every source."""
    d = texts(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return infer.synthetic_questions(d, "document_id", "chunk_index", _question_client, "Ask about: {content}")


@query("model_rerank", f"""WITH {LC}, {EV}, {sem_sql(60, 'lc', 'ev')},
s AS (SELECT query_id::BIGINT AS query_id, chunk_id, rank AS original_rank, CASE WHEN query_id % 3 = 1 OR chunk_id % 5 = 0 THEN NULL ELSE (chunk_id % 11)::DOUBLE END AS raw FROM sem WHERE rank <= 50),
o AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) IS NULL THEN 0 ELSE coalesce(raw, 5) / 10 END AS score FROM s)
SELECT query_id, chunk_id, original_rank, round(score, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM o) WHERE rank <= 10""")
def model_rerank(spark, sf):
    """The first 50 hits by a model's score; where a query's calls all failed, the order stays."""
    hits = S.semantic_topk(label_centres(spark, sf), vectors(spark, sf), 60).withColumnRenamed("rank", "original_rank")
    raw = F.when((F.col("query_id") % 3 != 1) & (F.col("chunk_id") % 5 != 0), (F.col("chunk_id") % 11).cast("double"))
    d = RR.model_rerank(hits.withColumn("raw", raw), "raw", 50, 10)
    return _big(d.select("query_id", "chunk_id", "original_rank", F.round("score", 6).alias("score"), "rank"), "original_rank", "rank")


def _digest_client():
    return lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts]


_NODE_TEXTS = f"""RECURSIVE {TREE[len("RECURSIVE "):]}, {PAGES}, nt AS (SELECT n.document_id, node_id, any_value(path) AS path, any_value(title) AS title, coalesce(string_agg(text || chr(10), '' ORDER BY page_number), '') AS text
FROM num n LEFT JOIN pg ON pg.document_id = n.document_id AND page_number BETWEEN start_index AND end_index GROUP BY 1, 2),
sm AS (SELECT *, md5('Summarise ' || title || ': ' || substring(text, 1, 10000)) AS summary FROM nt)"""


@query("node_summaries", f"WITH {_NODE_TEXTS} SELECT document_id, node_id, summary FROM sm")
def node_summaries(spark, sf):
    return _summaries(spark, sf).select("document_id", "node_id", "summary")


def _summaries(spark, sf):
    n = R.node_texts(nodes(spark, sf), pages(spark, sf))
    return R.summarise(n, _digest_client, "Summarise {title}: {text}")


@query("document_descriptions", f"""WITH {_NODE_TEXTS}, top AS (SELECT document_id, '[' || string_agg('{{"title":"' || title || '","node_id":"' || node_id || '","summary":"' || summary || '"}}', ',' ORDER BY path[1]) || ']' AS outline
FROM sm WHERE len(path) = 1 GROUP BY 1) SELECT document_id, md5('Describe: ' || outline) AS description FROM top""")
def document_descriptions(spark, sf):
    """A description per document from the titles and summaries of its top sections."""
    return R.describe_documents(checkpoint(_summaries(spark, sf), "summaries"), _digest_client, "Describe: {outline}")


# ------------------------------------------------------------------ replies, tags and templates

_FENCE = "chr(96) || chr(96) || chr(96)"
_REPLY = f"""rp AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Sure. ' || {_FENCE} || 'json' || chr(10) || '{{"id": ' || conv_id || ', "name": None,' || chr(10) || ' "tags": ["a", "t' || turn || '", ],}}' || {_FENCE} || ' Done.'
  WHEN 1 THEN {_FENCE} || '{{"id": ' || conv_id || ', "tags": []}}' || {_FENCE} WHEN 2 THEN '{{"id": ' || conv_id || ', "name": "' || role || '"}}' ELSE 'I cannot say. ["q' || conv_id || '", "why?"] and so on' END AS reply FROM conversations)"""


def _replies(spark, sf):
    c, t = table(spark, sf, "conversations"), F.col("turn")
    number, fence = F.col("conv_id").cast("string"), F.lit("```")
    first = F.concat(F.lit("Sure. "), fence, F.lit('json\n{"id": '), number, F.lit(', "name": None,\n "tags": ["a", "t'), t.cast("string"), F.lit('", ],}'), fence, F.lit(" Done."))
    second = F.concat(fence, F.lit('{"id": '), number, F.lit(', "tags": []}'), fence)
    third = F.concat(F.lit('{"id": '), number, F.lit(', "name": "'), F.col("role"), F.lit('"}'))
    last = F.concat(F.lit('I cannot say. ["q'), number, F.lit('", "why?"] and so on'))
    return c.select("conv_id", "turn", F.when(t % 4 == 0, first).when(t % 4 == 1, second).when(t % 4 == 2, third).otherwise(last).alias("reply"))


@query("model_replies", f"""WITH {_REPLY} SELECT conv_id, turn, CASE WHEN turn % 4 < 3 AND reply IS NOT NULL THEN conv_id END AS id, CASE WHEN turn % 4 = 2 THEN regexp_extract(reply, '"name": "(.*)"', 1) END AS name,
CASE turn % 4 WHEN 0 THEN 't' || turn END AS second_tag FROM rp""")
def model_replies(spark, sf):
    """Fenced, plain and broken JSON replies as columns."""
    v = _replies(spark, sf).withColumn("v", T.parse_reply(F.col("reply")))
    return v.select("conv_id", "turn", *[F.try_variant_get("v", p, k).alias(n) for n, p, k in (("id", "$.id", "bigint"), ("name", "$.name", "string"), ("second_tag", "$.tags[1]", "string"))])


@query("reply_arrays", f"WITH {_REPLY} SELECT conv_id, turn, unnest(['q' || conv_id, 'why?']) AS item FROM rp WHERE turn % 4 = 3")
def reply_arrays(spark, sf):
    """The JSON list inside free text; replies whose list is no JSON give nothing."""
    d = _replies(spark, sf).where(~F.col("reply").contains("```"))
    return d.select("conv_id", "turn", F.explode(T.json_array_in(F.col("reply"))).alias("item"))


@query("page_tags", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, md5('<physical_index_' || doc_id || '>' || chr(10) || text || chr(10) || '<physical_index_' || doc_id || '>' || chr(10) || chr(10)) AS digest, doc_id AS tagged,
CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 END AS plain, md5(substring(text, 1, 100)) AS head, 'Part ' || doc_id || CASE WHEN doc_id % 9 >= 5 THEN ': ' ELSE repeat('.', doc_id % 9) END || (doc_id % 50) AS contents_line,
ceil(length(text) / 4)::BIGINT AS n_tokens FROM d""")
def page_tags(spark, sf):
    """Pages in tags and the numbers read back, leading numbers, cut texts and dot leaders."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    labelled = T.labelled_page(n, text)
    plain = F.when(n % 3 == 0, F.concat(F.lit("  "), (n % 50).cast("string"), F.lit(" on"))).otherwise(F.lit("page x"))
    line = F.concat(F.lit("Part "), n.cast("string"), F.repeat(F.lit("."), (n % 9).cast("int")), (n % 50).cast("string"))
    return texts(spark, sf, "documents").select(
        "doc_id", F.md5(labelled).alias("digest"), T.page_tag_number(labelled).cast("bigint").alias("tagged"), T.page_tag_number(plain).cast("bigint").alias("plain"),
        F.md5(T.truncate(text, 100)).alias("head"), T.plain_dot_leaders(line).alias("contents_line"), T.estimate_tokens(text).cast("bigint").alias("n_tokens"))


@query("decline_answers", """SELECT item_id, 'Sorry. ' || CASE WHEN item_id % 3 = 0 THEN 'Could you say more?' ELSE substring(text, 1, 30) END || ' Thank you.' AS answer FROM benchmark""")
def decline_answers(spark, sf):
    prompt = F.when(F.col("item_id") % 3 != 0, F.substring("text", 1, 30)).otherwise(F.lit(""))
    return table(spark, sf, "benchmark").select("item_id", QF.decline_text(F.lit("Sorry. {clarificationPrompt} Thank you."), prompt, "Could you say more?").alias("answer"))


@query("list_marks", r"""WITH t AS (SELECT conv_id, turn, ['ii ', 'b ', '12 ', '3.) ', '', '1. 2] ', 'Vi  '][(turn % 7 + 1)::INT] || coalesce(text, '') AS marked FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(marked, '^(i{1,3}|iv|v|vi{0,3}|ix|x{1,3}|[a-z]|[0-9]+)\s+', '', 'i'), '^[\d.)\]]+\s*', ''), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS digest FROM t""")
def list_marks(spark, sf):
    """Leading list marks taken off every turn."""
    mark = F.element_at(F.array(*[F.lit(m) for m in ("ii ", "b ", "12 ", "3.) ", "", "1. 2] ", "Vi  ")]), (F.col("turn") % 7 + 1).cast("int"))
    return texts(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.strip_list_marks(F.concat(mark, F.coalesce("text", F.lit(""))))).alias("digest"))


@query("toc_read_rows", """WITH d AS (SELECT source AS document_id, doc_id AS page_number FROM documents WHERE source IS NOT NULL),
l AS (SELECT document_id, page_number, unnest([0, 1]) AS line FROM d),
r AS (SELECT *, CASE line WHEN 0 THEN (page_number + 1)::VARCHAR ELSE (page_number + 1) || '.1' END AS structure, CASE line WHEN 0 THEN 'Part ' || page_number ELSE 'About ' || page_number END AS title, page_number % 90 + line AS page FROM l)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, line) - 1 AS pos, structure, title, page FROM r""")
def toc_read_rows(spark, sf):
    """Contents pages with dot leaders, wide gaps and lines that are none, line by line."""
    n = F.col("doc_id")
    text = F.concat_ws("\n", F.lit("Contents"), F.concat((n + 1).cast("string"), F.lit(". Part "), n.cast("string"), F.lit(" ........ "), (n % 90).cast("string")),
                       F.concat((n + 1).cast("string"), F.lit(".1 About "), n.cast("string"), F.lit("    "), (n % 90 + 1).cast("string")), F.lit("a line without number"))
    p = table(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("document_id"), n.alias("page_number"), text.alias("text"))
    return _big(R.toc_rows(p), "page")


# ------------------------------------------------------------------ stored tables read back

@query("chunk_store", f"""SELECT doc_id AS document_id, 0::BIGINT AS chunk_index, md5(text) AS digest, len({sql_tokens('text')})::BIGINT AS n_tokens, array_to_string({sql_tokens('text')}[1:3], ' ') AS first_tokens,
len(embedding) = 384 AS has_local, len(embedding) = 1536 AS has_large FROM documents JOIN embeddings ON doc_id = vec_id""")
def chunk_store(spark, sf):
    """Chunks written by bucket, with tokens and a vector column per length, and read again."""
    d = corpus(spark, sf).where("embedding IS NOT NULL").select(F.col("chunk_id").alias("document_id"), F.lit(0).cast("bigint").alias("chunk_index"), F.col("text").alias("content"), "embedding")
    path = shared_dir(spark, "chunk-store")
    sinks.append_chunks(d, path)
    s = spark.read.parquet(path)
    return s.select("document_id", "chunk_index", F.md5("content").alias("digest"), F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join(F.slice("tokens", 1, 3), " ").alias("first_tokens"),
                    F.col("embedding_local").isNotNull().alias("has_local"), F.col("embedding_openai").isNotNull().alias("has_large"))


@query("question_set", """SELECT 'q' || item_id AS id, md5(text) AS digest, ['rates', 'relief', 'vague'][(item_id % 3 + 1)::INT] AS category FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 3 <> 2 AND item_id % 2 = 1""")
def question_set(spark, sf):
    """Question files written per part, read as lists; the active, hard ones that are not vague."""
    n = F.col("item_id")
    category = F.element_at(F.array(*[F.lit(c) for c in ("rates", "relief", "vague")]), (n % 3 + 1).cast("int"))
    row = F.struct(F.concat(F.lit("q"), n).alias("id"), F.col("text").alias("query"), category.alias("category"), F.when(n % 2 == 1, "hard").otherwise("easy").alias("difficulty"),
                   F.struct(F.when(n % 5 == 0, "draft").otherwise("active").alias("status")).alias("curation"))
    # a file holds one list: parts of about a hundred questions
    files = table(spark, sf, "benchmark").groupBy(F.floor(n / 100).alias("part")).agg(F.to_json(F.struct(F.collect_list(row).alias("questions"))).alias("value"))
    path = shared_dir(spark, "questions")
    files.repartition("part").write.partitionBy("part").text(path)
    picked = QS.select_questions(QS.load_questions(spark, path), difficulty="hard")
    return picked.select("id", F.md5("query").alias("digest"), "category")


@query("result_files", """SELECT o_orderkey AS id, o_orderpriority AS configuration, o_totalprice AS cost, o_orderstatus = 'F' AS passed FROM orders""")
def result_files(spark, sf):
    """Results written as JSON lines and read again."""
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("configuration"), F.col("o_totalprice").cast("double").alias("cost"), (F.col("o_orderstatus") == "F").alias("passed"))
    path = shared_dir(spark, "results")
    sinks.write_results(d, path)
    return spark.read.schema(d.schema).json(path)


@query("comparison_csv", """WITH r AS (SELECT o_custkey AS id, o_orderstatus AS configuration, o_comment AS response, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n, 'said "' || o_clerk || '", on ' || o_orderkey || chr(10) || 'then' AS o_comment FROM (SELECT *, 'clerk ' || o_custkey AS o_clerk FROM orders)) WHERE n = 1)
SELECT id::VARCHAR AS id, max(CASE WHEN configuration = 'F' THEN substring(replace(response, chr(10), ' '), 1, 500) END) AS f_answer, max(CASE WHEN configuration = 'O' THEN substring(replace(response, chr(10), ' '), 1, 500) END) AS o_answer,
max(CASE WHEN configuration = 'F' THEN 'true' END) AS f_passed FROM r GROUP BY 1""")
def comparison_csv(spark, sf):
    """One CSV row per question with the columns of every configuration, quotes and line ends in answers, read again."""
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("k"))
    said = F.concat(F.lit('said "clerk '), F.col("o_custkey"), F.lit('", on '), F.col("k"), F.lit("\nthen"))
    d = o.select(F.col("o_custkey").alias("id"), F.lit("q").alias("query"), F.lit("c").alias("category"), F.lit("easy").alias("difficulty"), F.col("o_orderstatus").alias("configuration"),
                 F.lit(True).alias("passed"), F.lit(0.5).alias("accuracy"), F.lit(1.0).alias("duration"), F.lit(0.25).alias("cost"), said.alias("response"))
    path = shared_dir(spark, "comparison")
    sinks.write_comparison_csv(sinks.comparison_rows(d, ["F", "O", "P"]), path)
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return back.select("id", F.col("F_answer").alias("f_answer"), F.col("O_answer").alias("o_answer"), F.col("F_passed").alias("f_passed"))


# ------------------------------------------------------------------ SQL functions

@query("sql_functions", r"""SELECT a.doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, round(0.6::DOUBLE / (60 + a.doc_id % 20), 9) AS term, ceil(length(text) / 4)::BIGINT AS n_tokens,
md5(regexp_replace(regexp_replace(regexp_replace('<p>' || text || '</p>', '<[^>]*>', ' ', 'g'), '[\s\x{00a0}]+', ' ', 'g'), '^ +| +$', '', 'g')) AS plain
FROM (SELECT doc_id, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON b.vec_id = a.doc_id + 1""")
def sql_functions(spark, sf):
    """The scalar rules as a SQL user calls them."""
    FS.register(spark)
    corpus(spark, sf).where("embedding IS NOT NULL").select("chunk_id", "text", F.col("embedding").cast("array<double>").alias("v")).createOrReplaceTempView("sql_chunks")
    vectors(spark, sf).select("chunk_id", F.col("embedding").cast("array<double>").alias("v")).createOrReplaceTempView("sql_vectors")
    return spark.sql("""SELECT a.chunk_id AS doc_id, round(cosine_similarity(a.v, b.v), 6) AS similarity, round(rrf_term(a.chunk_id % 20, 60, 0.6D), 9) AS term, estimate_tokens(a.text) AS n_tokens,
        md5(strip_html('<p>' || a.text || '</p>')) AS plain FROM sql_chunks a JOIN sql_vectors b ON b.chunk_id = a.chunk_id + 1""")


@query("sql_split_cover", r"""SELECT doc_id, md5(regexp_replace(text, '[\x{1c}-\x{1f}\s\p{Z}\x{85}]+', '', 'g')) AS digest, true AS fits FROM documents WHERE length(trim(text)) > 0""")
def sql_split_cover(spark, sf):
    """The splitter as a table function over a partitioned table: chunks hold every non-blank character once, in order."""
    FS.register(spark)
    texts(spark, sf, "documents").where("length(trim(text)) > 0").select("doc_id", "text").createOrReplaceTempView("sql_documents")
    parts = spark.sql("SELECT * FROM split_documents(TABLE(SELECT doc_id, text FROM sql_documents) PARTITION BY (doc_id), 400, 0)")
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda s: s["content"]), "").alias("t"), F.max(F.length("content")).alias("n"))
    return whole.select("doc_id", F.md5(F.regexp_replace("t", r"[\x1c-\x1f\s\p{Z}\x{85}]+", "")).alias("digest"), (F.col("n") <= 400).alias("fits"))


# ------------------------------------------------------------------ reports

@query("mean_first_rank", f"""WITH {LC}, {EV}, {sem_sql(50, 'lc', 'ev')}, f AS (SELECT query_id, min(rank) AS r FROM sem JOIN ev USING (chunk_id) WHERE label = query_id AND chunk_id % 7 = 0 GROUP BY 1),
a AS (SELECT lc.query_id % 2 AS part, r FROM lc LEFT JOIN f USING (query_id)) SELECT part::BIGINT AS part, round(coalesce(avg(r), 999), 6)::DOUBLE AS mean_rank, count(*) AS n FROM a GROUP BY 1""")
def mean_first_rank(spark, sf):
    qs, v = label_centres(spark, sf), vectors(spark, sf)
    relevant = v.where("chunk_id % 7 = 0").select(F.col("label").cast("bigint").alias("query_id"), "chunk_id")
    r = E.first_relevant_rank(S.semantic_topk(qs, v, 50), relevant, qs)
    return r.groupBy((F.col("query_id") % 2).alias("part")).agg(F.round(E.mean_rank(F.col("first_rank")), 6).alias("mean_rank"), F.count(F.lit(1)).alias("n"))


@query("latency_change", """SELECT o_orderpriority, round(avg(o_totalprice * 0.9 + o_custkey) - avg(o_totalprice), 4) AS delta, round((avg(o_totalprice * 0.9 + o_custkey) - avg(o_totalprice)) / avg(o_totalprice), 6) AS share FROM
(SELECT o_orderpriority, o_custkey, o_totalprice::DOUBLE AS o_totalprice FROM orders) GROUP BY 1""")
def latency_change(spark, sf):
    price = F.col("o_totalprice").cast("double")
    d = table(spark, sf, "orders").groupBy("o_orderpriority").agg(E.latency_change(price, price * 0.9 + F.col("o_custkey")).alias("c"))
    return d.select("o_orderpriority", F.round("c.delta", 4).alias("delta"), F.round("c.share", 6).alias("share"))


@query("metric_deltas", """WITH b AS (SELECT event_type AS metric, round(avg(value), 6) AS before FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type AS metric, round(avg(value), 6) AS after FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT metric, before, after, round(after - before, 6) AS delta FROM b JOIN a USING (metric)""")
def metric_deltas(spark, sf):
    e = table(spark, sf, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return E.metric_deltas(half(0), half(1)).withColumn("delta", F.round("delta", 6))


@query("weak_categories", """WITH r AS (SELECT 'm' || user_id % 3 AS model, event_type AS category, value - 10 AS s, event_type = 'error' AND user_id % 2 = 0 AS bad FROM events),
g AS (SELECT model, category, round(avg((NOT bad AND s > 0)::INT), 6) AS success_rate FROM r GROUP BY 1, 2) SELECT * FROM g WHERE success_rate < 0.7""")
def weak_categories(spark, sf):
    """Categories of each model with less than 70 per cent success."""
    bad = (F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)
    r = table(spark, sf, "events").select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("category"), (F.col("value") - 10).alias("total_score"), F.when(bad, "failed").alias("error"))
    s = E.model_summary(r, r.select("category").distinct(), r)
    return E.weak_categories(s).select("model", "category", F.round("success_rate", 6).alias("success_rate"))


@query("retry_average", "SELECT round(avg(value), 6) AS avg, count(*) AS n FROM events WHERE event_type <> 'error'")
def retry_average(spark, sf):
    return E.retry_average(table(spark, sf, "events"), F.col("event_type") != "error", "value").withColumn("avg", F.round("avg", 6))


@query("source_display", f"""WITH {QV}, {DOCS}, {sem_sql(5)} SELECT query_id, rank AS "index", chunk_id, substring(text, 1, 500) AS content FROM sem JOIN cv USING (chunk_id)""")
def source_display(spark, sf):
    c = corpus(spark, sf)
    hits = S.semantic_topk(bench_queries(spark, sf), c, 5).join(c.select("chunk_id", F.col("text").alias("content")), "chunk_id")
    return X.display_rows(hits).select("query_id", F.col("index").cast("bigint").alias("index"), "chunk_id", "content")


@query("source_documents", f"""WITH {TREE}, s AS (SELECT item_id AS query_id, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][(item_id % 5 + 1)::INT] AS document_id, printf('%04d', item_id % 40) AS node_id FROM benchmark)
SELECT query_id, document_id, node_id, document_id || '.pdf' AS file_name FROM s JOIN num USING (document_id, node_id)""")
def source_documents(spark, sf):
    """Sources with the file of the document that owns the node."""
    seg = F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), (F.col("item_id") % 5 + 1).cast("int"))
    s = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), seg.alias("document_id"), F.format_string("%04d", F.col("item_id") % 40).alias("node_id"))
    named = nodes(spark, sf).withColumn("file_name", F.concat("document_id", F.lit(".pdf")))
    return X.attribute_documents(s, named).select("query_id", "document_id", "node_id", "file_name")
