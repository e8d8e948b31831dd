"""Catalogue: streams, run over the stored events as if they arrived."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.plans.common import query, table
from lexloom.session import shared_dir
from lexloom.streaming import requests as Q, sinks


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return Q.with_event_time(s)


@query("stream_request_metrics", """SELECT user_id AS request_id, count(*) AS token_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE AS stream_ms,
round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS tokens_per_second FROM events GROUP BY 1""")
def stream_request_metrics(spark, sf):
    tokens = event_stream(spark, sf).withColumnRenamed("user_id", "request_id")
    done = sinks.run_available(Q.request_aggregate(tokens), ["request_id"], "request-metrics")
    d = Q.with_rates(done)
    return d.select("request_id", "token_count", "stream_ms", F.round("tokens_per_second", 9).alias("tokens_per_second"))


@query("stream_session_activity", "SELECT user_id, epoch_us(max(ts)) AS last_us, count(*) AS n_messages FROM events GROUP BY 1")
def stream_session_activity(spark, sf):
    d = sinks.run_available(Q.session_activity(event_stream(spark, sf), "user_id"), ["user_id"], "session-activity")
    return d.select("user_id", F.unix_micros("last_activity").alias("last_us"), "n_messages")


@query("stream_windowed", """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS highest FROM events GROUP BY 1, 2""")
def stream_windowed(spark, sf):
    d = sinks.run_available(Q.windowed(event_stream(spark, sf), ["event_type"], "value"), ["window_start", "event_type"], "windowed")
    return d.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", F.round("total", 6).alias("total"), "highest")


@query("stream_ttl_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_ttl_dedupe(spark, sf):
    """With a time to live longer than the stream, one row per key is left."""
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return sinks.run_available(Q.unseen(s, ["user_id", "event_type"], ttl="3650 days").select("user_id", "event_type"), ["user_id", "event_type"], "ttl", "append")


@query("stream_feedback", "SELECT user_id, event_id % 7 AS message_id, arg_min(value, event_id) AS query, arg_max(event_type, event_id) AS feedback_type, arg_max(props, event_id) AS feedback_text FROM events GROUP BY 1, 2")
def stream_feedback(spark, sf):
    e = event_stream(spark, sf).select("event_id", "ts", "user_id", (F.col("event_id") % 7).alias("message_id"), F.col("value").alias("query"),
                                       F.col("event_type").alias("feedback_type"), F.col("props").alias("feedback_text"))
    log = shared_dir(spark, "feedback")
    sinks.start_feedback(e, log, shared_dir(spark, "feedback-state"), ["query"], order=["ts", "event_id"]).awaitTermination()
    return sinks.read_feedback(spark, log, ["query"])


@query("stream_session_filter", "SELECT event_id, event_type FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def stream_session_filter(spark, sf):
    """Inserts of the last user."""
    last = table(spark, sf, "events").agg(F.max("user_id")).first()[0]
    s = Q.of_session(event_stream(spark, sf), last, "user_id").select("event_id", "event_type")
    return sinks.run_available(s, ["event_id"], "session-filter", "append")


_DATA = """ed AS (SELECT conv_id, turn, role, CASE WHEN turn % 7 = 5 THEN '{"choices": [' WHEN turn % 7 = 6 THEN '[DONE]' WHEN role = 'system' THEN json_object('thinking', text)::VARCHAR
  WHEN role = 'user' THEN json_object('messageIds', json_object('userMessageId', conv_id::VARCHAR))::VARCHAR ELSE json_object('choices', [json_object('delta', json_object('content', text))])::VARCHAR END AS data, text FROM conversations)"""


@query("event_routing", f"""WITH {_DATA} SELECT conv_id, turn, CASE WHEN data = '[DONE]' THEN 'done' WHEN role = 'system' THEN 'thinking' WHEN role = 'user' THEN 'message_ids' WHEN text <> '' THEN 'content' ELSE 'other' END AS kind,
CASE WHEN data <> '[DONE]' AND role NOT IN ('system', 'user') THEN nullif(text, '') END AS content FROM ed WHERE turn % 7 <> 5""")
def event_routing(spark, sf):
    return Q.route_events(_raw_events(spark, sf)).select("conv_id", "turn", "kind", "content")


def _raw_events(spark, sf):
    c = table(spark, sf, "conversations")
    user = F.to_json(F.struct(F.struct(F.col("conv_id").cast("string").alias("userMessageId")).alias("messageIds")))
    token = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    data = F.when(F.col("turn") % 7 == 5, '{"choices": [').when(F.col("turn") % 7 == 6, Q.DONE).when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("thinking")))) \
        .when(F.col("role") == "user", user).otherwise(token)
    return c.select("conv_id", "turn", data.alias("data"))


@query("metric_log", """SELECT 'req_' || event_id AS request_id, event_type AS model, event_id * 3 AS ttft, value AS rate FROM events""")
def metric_log(spark, sf):
    e = table(spark, sf, "events")
    body = F.to_json(F.struct(F.concat(F.lit("req_"), "event_id").alias("requestId"), F.col("event_type").alias("model"), (F.col("event_id") * 3).alias("llmTtftMs"), F.col("value").alias("tokensPerSecond")))
    noise = e.select(F.concat(F.lit("plain line "), "event_id").alias("value"))
    lines = e.select(F.concat(F.lit("[METRICS_JSON] "), body).alias("value")).unionByName(noise)
    return Q.metric_log_rows(lines).select(F.col("requestId").alias("request_id"), "model", F.col("llmTtftMs").alias("ttft"), F.col("tokensPerSecond").alias("rate"))


_TOKENS = """tk AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS request_id, ts, event_id % 7 AS d, props FROM events WHERE event_id % 7 > 1),
ends AS (SELECT epoch_ms(max(ts)) - 600000 AS watermark FROM tk)"""


def _token_stream(spark, sf):
    """Events as an answer stream: a request per user and day, with blanks, broken events and closing marks."""
    d = F.col("event_id") % 7
    token = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("props").alias("content")).alias("delta"))).alias("choices")))
    data = F.when(d == 0, "  ").when(d == 1, '{"choices": [').when(d == 2, F.to_json(F.struct(F.col("event_type").alias("thinking")))) \
        .when(d == 5, '{"grounding": 1}').when(d == 6, Q.DONE).otherwise(token)
    request = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    return event_stream(spark, sf).select(request.alias("request_id"), "ts", data.alias("data"))


@query("stream_requests_done", f"""WITH {_TOKENS},
r AS (SELECT request_id, min(ts) AS start, min(ts) FILTER (WHERE d IN (3, 4)) AS f, max(ts) FILTER (WHERE d IN (3, 4)) AS l, count(*) FILTER (WHERE d IN (3, 4)) AS n,
  coalesce(sum(length(props)) FILTER (WHERE d IN (3, 4)), 0)::BIGINT AS chars, bool_or(d = 6) AS finished FROM tk GROUP BY 1)
SELECT request_id, coalesce((epoch_us(f) - epoch_us(start)) / 1000.0::DOUBLE, -1) AS ttft_ms, coalesce((epoch_us(l) - epoch_us(f)) / 1000.0::DOUBLE, 0) AS stream_ms, n AS token_count, chars AS response_chars, finished
FROM r, ends WHERE finished OR epoch_ms(start) + 600000 < watermark""")
def stream_requests_done(spark, sf):
    """Requests that end with [DONE] or their time-out; those still running at the end of the stream are not reported."""
    d = sinks.run_available(Q.request_metrics(_token_stream(spark, sf)), ["request_id"], "requests-done", "append")
    return d.select("request_id", F.coalesce("ttft_ms", F.lit(-1.0)).alias("ttft_ms"), "stream_ms", "token_count", "response_chars", "finished")


@query("stream_event_routing", f"""WITH {_TOKENS} SELECT request_id, epoch_us(ts) AS at_us, CASE d WHEN 2 THEN 'thinking' WHEN 5 THEN 'grounding' WHEN 6 THEN 'done' ELSE 'content' END AS kind,
CASE WHEN d IN (3, 4) THEN props END AS content FROM tk""")
def stream_event_routing(spark, sf):
    routed = Q.route_events(_token_stream(spark, sf)).select("request_id", F.unix_micros("ts").alias("at_us"), "kind", "content")
    return sinks.run_available(routed, ["request_id", "at_us"], "routing", "append")


@query("stream_sessions_closed", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
w AS (SELECT user_id, min(ts) AS f, max(ts) AS l, count(*) AS n_messages FROM s GROUP BY user_id, n)
SELECT user_id, epoch_us(f) AS first_us, epoch_us(l) AS last_us, n_messages FROM w WHERE l + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions_closed(spark, sf):
    """Activity of sessions that ended: six hours without a message close one and free its state."""
    d = Q.request_sessions(event_stream(spark, sf), "user_id", gap="6 hours")
    done = sinks.run_available(d, ["user_id", "first_us"], "sessions-closed", "append")
    return done.select("user_id", "first_us", "last_us", F.col("token_count").alias("n_messages"))


@query("stream_ttl_unseen", """WITH RECURSIVE j AS (SELECT a.user_id, a.event_type, a.ts, min(b.ts) AS next FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts >= a.ts + INTERVAL 7 DAY GROUP BY 1, 2, 3),
e AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2 UNION SELECT j.user_id, j.event_type, j.next FROM e JOIN j USING (user_id, event_type, ts) WHERE j.next IS NOT NULL)
SELECT user_id, event_type, epoch_us(ts) AS computed_us FROM e""")
def stream_ttl_unseen(spark, sf):
    """What a cache that keeps entries for seven days has to compute."""
    d = Q.unseen_within(event_stream(spark, sf), ["user_id", "event_type"], 7 * 86_400_000_000)
    done = sinks.run_available(d, ["user_id", "event_type", "ts"], "ttl-unseen", "append")
    return done.select("user_id", "event_type", F.unix_micros("ts").alias("computed_us"))


@query("stream_metric_log", """SELECT 'req_' || event_id AS request_id, event_type AS model, event_id * 3 AS ttft, value AS rate FROM events""")
def stream_metric_log(spark, sf):
    """Metric lines of a log folder that is read as a stream."""
    e = table(spark, sf, "events")
    body = F.to_json(F.struct(F.concat(F.lit("req_"), "event_id").alias("requestId"), F.col("event_type").alias("model"), (F.col("event_id") * 3).alias("llmTtftMs"), F.col("value").alias("tokensPerSecond")))
    folder = shared_dir(spark, "log-lines")
    e.select(F.explode(F.array(F.concat(F.lit("[METRICS_JSON] "), body), F.concat(F.lit("plain line "), F.col("event_id").cast("string")), F.lit("[METRICS_JSON] {broken"))).alias("value")).write.text(folder)
    rows = Q.metric_log_rows(spark.readStream.text(folder))
    done = sinks.run_available(rows, ["requestId"], "metric-log", "append")
    return done.select(F.col("requestId").alias("request_id"), "model", F.col("llmTtftMs").alias("ttft"), F.col("tokensPerSecond").alias("rate"))
