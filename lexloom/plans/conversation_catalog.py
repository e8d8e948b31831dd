"""Catalogue: conversations, stored tables and their updates, response timing."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import vocab
from lexloom.functions import scoring, text as T
from lexloom.operators import conversation as V, ordered, tables as TB
from lexloom.plans.common import QUESTIONS_SQL, q, query, questions, sql_list, sql_tokens, table, texts
from lexloom.sources import files as FS


def messages(spark, sf):
    return table(spark, sf, "conversations")


def events(spark, sf):
    return table(spark, sf, "events")


def _big(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


@query("recent_messages", "SELECT conv_id, turn, role, recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations) WHERE recency <= 10")
def recent_messages(spark, sf):
    return _big(V.recent_messages(messages(spark, sf), 10).select("conv_id", "turn", "role", "recency"), "recency")


@query("token_window", """SELECT conv_id, turn, tokens, tokens_kept FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS tokens_kept
FROM (SELECT *, ceil(length(text) / 4)::BIGINT AS tokens FROM conversations)) WHERE tokens_kept <= 300""")
def token_window(spark, sf):
    return V.token_window(messages(spark, sf), 300, T.estimate_tokens(F.col("text"))).select("conv_id", "turn", "tokens", "tokens_kept")


@query("prior_user_turn", """SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prior_user FROM conversations""")
def prior_user_turn(spark, sf):
    return V.prior_user_turn(messages(spark, sf)).select("conv_id", "turn", F.md5("prior_user").alias("prior_user"))


# the conversations are invented words, so questions of the customer's orders serve as messages here
_ENT = ("list_concat(list_concat(list_transform(regexp_extract_all(context, '(?i)Article\\s+(\\d+)', 1), lambda n: 'Article ' || n), list_filter(["
        + ", ".join(f"CASE WHEN contains(lower(context), {q(c.lower())}) THEN {q(c)} END" for c in vocab.CONTEXT_CONCEPTS)
        + "], lambda c: c IS NOT NULL)), regexp_extract_all(context, '(?i)Federal\\s+Decree[- ]Law(?:\\s+No\\.?)?\\s*(\\d+)?'))")


@query("follow_up_context", f"""WITH {QUESTIONS_SQL}, c AS (SELECT *, coalesce(string_agg(question, ' ') OVER (PARTITION BY owner ORDER BY question_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM questions),
e AS (SELECT *, {_ENT} AS ents FROM c), u AS (SELECT *, list_filter(ents, lambda x, i: list_position(ents, x) = i) AS found FROM e)
SELECT owner, question_id, context, CASE WHEN {"(" + " OR ".join(f"contains(lower(question), {q(w)})" for w in vocab.FOLLOW_UP_MARKERS) + ")"} AND length(question) < 100 AND len(found) > 0
  THEN 'Regarding ' || array_to_string(found[1:3], ', ') || ': ' || question ELSE question END AS question FROM u""")
def follow_up_context(spark, sf):
    m = questions(spark, sf).withColumnRenamed("question", "text")
    return V.with_context(m, 4, "owner", "question_id").select("owner", "question_id", "context", "question")


@query("recent_turn_context", """SELECT conv_id, turn, md5(coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '')) AS digest FROM conversations""")
def recent_turn_context(spark, sf):
    return V.with_context(messages(spark, sf)).select("conv_id", "turn", F.md5("context").alias("digest"))


# ------------------------------------------------------------------ tables

_FB = """fb AS (SELECT event_id, ts, user_id, event_id % 7 AS message_id, event_type AS feedback_type, props AS feedback_text, value AS query_value FROM events)"""


def _feedback(spark, sf):
    return events(spark, sf).select("event_id", "ts", "user_id", (F.col("event_id") % 7).alias("message_id"), F.col("event_type").alias("feedback_type"),
                                    F.col("props").alias("feedback_text"), F.col("value").alias("query_value"))


@query("feedback_upsert", f"""WITH {_FB} SELECT user_id, message_id, arg_min(query_value, event_id) AS query_value, arg_max(feedback_type, event_id) AS feedback_type, arg_max(feedback_text, event_id) AS feedback_text
FROM fb GROUP BY 1, 2""")
def feedback_upsert(spark, sf):
    return TB.fold_feedback(_feedback(spark, sf), ["user_id", "message_id"], ["query_value"], ["feedback_type", "feedback_text"], ["ts", "event_id"])


@query("status_history", """WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, arg_max(event_type, event_id) AS status, epoch_us(min(ts) FILTER (WHERE event_type IN ('purchase', 'error') AND coalesce(prev NOT IN ('purchase', 'error'), true))) AS processed_us, count(*) AS n_updates FROM s GROUP BY 1""")
def status_history(spark, sf):
    out = TB.fold_status(events(spark, sf), "user_id", "event_type", "ts", "event_id", F.to_date("ts"), ["purchase", "error"])
    return out.select("user_id", "status", F.unix_micros(F.col("processed_at").cast("timestamp")).alias("processed_us"), "n_updates")


@query("cascade_delete", """SELECT 'orders' AS tbl, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def cascade_delete(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    o2, l2 = TB.cascade_delete([(o, "o_orderkey"), (li, "l_orderkey")], o.where(F.col("o_orderstatus") == "F"), "o_orderkey")
    a = o2.agg(F.lit("orders").alias("tbl"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("keys"))
    return a.unionByName(l2.agg(F.lit("lineitem").alias("tbl"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("keys")))


@query("incremental_scan", """SELECT lang AS user_id, source || '/' || doc_id AS file_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_scan(spark, sf):
    name = F.concat("source", F.lit("/"), "doc_id")
    d = texts(spark, sf, "documents")
    loaded = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("lang").alias("user_id"), name.alias("file_name"))
    return FS.new_files(d.select(F.col("lang").alias("user_id"), name.alias("file_name")), loaded)


@query("profile_default", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(replace(c_name, '#', '.')) END AS full_name, o.k IS NULL AS is_new
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON k = c_custkey""")
def profile_default(spark, sf):
    c = table(spark, sf, "customer")
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    users = c.select(F.col("c_custkey").alias("id"), mail.alias("email"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("full_name"))
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return TB.ensure_profiles(users, known).select("id", "full_name", "is_new")


@query("insert_defaults", """SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN props END, 'New Chat') AS title, coalesce(CASE WHEN value > 20 THEN event_type END, 'pending') AS status FROM events""")
def insert_defaults(spark, sf):
    d = events(spark, sf).select("event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("title"), F.when(F.col("value") > 20, F.col("event_type")).alias("status"))
    return TB.with_defaults(d, {"title": "New Chat", "status": "pending"})


@query("session_patch", """WITH u AS (SELECT o_custkey AS id, max(o_orderpriority) AS title, min(o_orderdate) AS m FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(title, c_name) AS title, c_mktsegment AS model, u.id IS NOT NULL AS touched FROM customer LEFT JOIN u ON u.id = c_custkey""")
def session_patch(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("model"), F.lit(False).alias("touched"))
    u = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("model"))
    return TB.patch(t, u, ["id"], ["title", "model"], "touched", F.lit(True))


@query("owner_children", """SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""")
def owner_children(spark, sf):
    parents = TB.owned(table(spark, sf, "customer"), "BUILDING", "c_mktsegment")
    return TB.children_of(table(spark, sf, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("newest_documents", """SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10""")
def newest_documents(spark, sf):
    out = TB.recent_per_key(events(spark, sf), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 10)
    return _big(out.select("user_id", "event_id", "rank"), "rank")


@query("message_sources", """SELECT event_id, user_id, json_extract_string(props, '$.k') AS sources FROM events""")
def message_sources(spark, sf):
    d = events(spark, sf).select("event_id", "user_id", F.parse_json(F.regexp_replace("props", '"k"', '"sources"')).alias("metadata"))
    return TB.message_rows(d)


@query("search_tokens", f"""SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens, md5(array_to_string({sql_tokens('text')}, ' ')) AS digest FROM documents""")
def search_tokens(spark, sf):
    d = TB.with_search_tokens(texts(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("as_of_state", """WITH p AS (SELECT u.user_id, d.ts FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events) d)
SELECT p.user_id, epoch_us(p.ts) AS probe_us, e.event_type AS state FROM p ASOF LEFT JOIN events e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def as_of_state(spark, sf):
    """State of every user at the start of every day. The day list is bounded by the calendar."""
    e = events(spark, sf)
    days = e.agg(F.date_trunc("day", F.min("ts")).alias("a"), F.date_trunc("day", F.max("ts")).alias("b"))
    lo, hi = days.select("a").scalar(), days.select("b").scalar()
    grid = F.explode(F.sequence(lo.cast("timestamp"), hi.cast("timestamp"), F.expr("INTERVAL 1 DAY")))
    probes = e.select("user_id").distinct().select("user_id", grid.alias("t")).select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    out = TB.as_of(probes, e, "user_id", "ts", "event_type", "state", F.to_date("ts"))
    return out.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("probe_us"), "state")


@query("timeline_range", """SELECT user_id, event_id, epoch_us(ts) AS at_us, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00' AND event_type IN ('click', 'view')""")
def timeline_range(spark, sf):
    e = TB.optional_types(events(spark, sf), "event_type", ["click", "view"])
    e = TB.between_times(e, "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return e.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_type")


@query("token_cost", """SELECT l_returnflag AS model, sum(l_quantity::BIGINT)::BIGINT AS tokens_in, round(sum(l_quantity * CASE WHEN l_returnflag = 'R' THEN 2.5e-6 ELSE 1.5e-7 END + l_linenumber * CASE WHEN l_returnflag = 'R' THEN 1e-5 ELSE 6e-7 END), 6) AS cost
FROM lineitem GROUP BY 1""")
def token_cost(spark, sf):
    model = F.when(F.col("l_returnflag") == "R", "gpt-4o").when(F.col("l_returnflag") == "A", "gpt-4o-mini").otherwise("unlisted")
    d = table(spark, sf, "lineitem").select("l_returnflag", model.alias("m"), F.col("l_quantity").alias("i"), F.col("l_linenumber").alias("o"))
    return TB.token_costs(d, "m", "i", "o").groupBy(F.col("l_returnflag").alias("model")).agg(F.sum(F.col("i").cast("bigint")).alias("tokens_in"), F.round(F.sum("cost"), 6).alias("cost"))


# ------------------------------------------------------------------ timing

_TIMING = """tm AS (SELECT user_id, count(*) AS token_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE AS stream_ms FROM events GROUP BY 1)"""


@query("latency_metrics", f"""WITH {_TIMING} SELECT user_id, token_count, 0.0::DOUBLE AS ttft_ms, round(stream_ms, 3) AS stream_ms, round(CASE WHEN stream_ms > 0 THEN token_count / (stream_ms / 1000) ELSE 0 END, 9) AS tokens_per_second FROM tm""")
def latency_metrics(spark, sf):
    d = V.request_timing(events(spark, sf), "user_id", "ts")
    return d.select("user_id", "token_count", "ttft_ms", F.round("stream_ms", 3).alias("stream_ms"), F.round("tokens_per_second", 9).alias("tokens_per_second"))


@query("latency_percentiles", """SELECT event_type, count(*) AS n, min(value) AS min, round(avg(value), 6) AS avg, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf):
    d = V.timing_report(events(spark, sf), ["event_type"], "value", 5.0)
    return d.select("event_type", "n", "min", F.round("avg", 6).alias("avg"), "max", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("stored_timestamps", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) % 1000000 // 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts + INTERVAL 1 HOUR) AS expires_us FROM events""")
def stored_timestamps(spark, sf):
    t = F.col("ts").cast("timestamp")
    return events(spark, sf).select("event_id", scoring.iso_timestamp(t).alias("iso"), F.unix_micros(scoring.expires_at(t)).alias("expires_us"))


@query("running_index", """SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER w AS n, sum(l_quantity) OVER w AS total FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)""")
def running_index(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    order, bucket = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], F.floor(F.col("l_orderkey") / 4096)
    d = ordered.row_index(li, ["l_suppkey"], order, "n", bucket, start=1)
    d = ordered.running_sum(d, ["l_suppkey"], order, F.col("l_quantity"), "total", bucket)
    return d.select("l_suppkey", "l_orderkey", "l_linenumber", "n", "total")
