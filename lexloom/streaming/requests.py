"""Answer streams: event parsing and routing, request metrics, activity, deduplication.

Policy: event time in ``ts`` (TIMESTAMP), watermark 10 minutes, later rows are dropped and
counted by the state operators (``LateRows``). A request ends with its ``[DONE]`` event
or when its time-out passes.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.functions import scoring

WATERMARK = "10 minutes"
DONE = "[DONE]"


# ------------------------------------------------------------------ rows of events

def strip_prefix(line: Column) -> Column:
    """Payload of a ``data: …`` line, trimmed; null for other lines."""
    trimmed = F.trim(line)
    return F.when(trimmed.startswith("data: "), F.trim(F.substring(trimmed, 7, 2147483647)))


def route_events(events: DataFrame, data: str = "data") -> DataFrame:
    """Typed columns of JSON events; blanks and malformed events are dropped.

    kind is the first of error, thinking, sources, message_ids, filtered, grounding,
    content, done that applies, 'other' otherwise.
    """
    d = events.withColumn("__t", F.trim(F.col(data))).where(F.col("__t") != "")
    d = d.withColumn("__v", F.try_parse_json("__t")).where((F.col("__t") == DONE) | F.col("__v").isNotNull())
    def at(path, kind="string"):
        return F.try_variant_get("__v", path, kind)
    d = d.withColumns({
        "content": F.nullif(at("$.choices[0].delta.content"), F.lit("")), "thinking": at("$.thinking"), "sources": at("$.sources"),
        "user_message_id": at("$.messageIds.userMessageId"), "assistant_message_id": at("$.messageIds.assistantMessageId"),
        "filtered_sources": at("$.filteredSources"), "filtered_content": at("$.filteredContent"), "grounding": at("$.grounding"), "error": at("$.error"),
    })
    kind = scoring.first_of([
        (F.col("__t") == DONE, F.lit("done")), (F.col("error").isNotNull(), F.lit("error")), (F.col("thinking").isNotNull(), F.lit("thinking")),
        (F.col("filtered_sources").isNotNull(), F.lit("filtered")), (F.col("sources").isNotNull(), F.lit("sources")),
        (F.col("user_message_id").isNotNull() | F.col("assistant_message_id").isNotNull(), F.lit("message_ids")),
        (F.col("grounding").isNotNull(), F.lit("grounding")), (F.col("content").isNotNull(), F.lit("content")),
    ], F.lit("other"))
    return d.withColumn("kind", kind).drop("__t", "__v")


def with_event_time(events: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Event time as TIMESTAMP (watermarks refuse TIMESTAMP_NTZ) with the watermark set."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


class LateRows(StreamingQueryListener):
    """Counts the rows each query drops behind its watermark, over all its batches.

    Add it to the session before the query starts: ``spark.streams.addListener(LateRows())``.
    Spark itself only remembers the last hundred batches.
    """

    def __init__(self):
        self._dropped: dict[str, int] = {}

    def onQueryStarted(self, event):
        self._dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        self._dropped[run] = self._dropped.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def of(self, query) -> int:
        """Rows dropped by the query so far; complete once its last progress event has arrived."""
        return self._dropped.get(str(query.runId), 0)


# ------------------------------------------------------------------ aggregations

def request_aggregate(tokens: DataFrame, request: str = "request_id", ts: str = "ts") -> DataFrame:
    """first, last and number of token events per request: mergeable, batch or update mode."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return tokens.groupBy(request).agg(F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count(F.lit(1)).alias("token_count"))


def request_sessions(tokens: DataFrame, request: str = "request_id", ts: str = "ts", gap: str = "10 minutes") -> DataFrame:
    """The same with state that ends: a request is closed ``gap`` after its last event."""
    t = F.unix_micros(F.col(ts))
    out = tokens.groupBy(request, F.session_window(ts, gap).alias("session")).agg(F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count(F.lit(1)).alias("token_count"))
    return out.drop("session")


def with_rates(aggregated: DataFrame) -> DataFrame:
    stream = (F.col("last_us") - F.col("first_us")) / 1000.0
    return aggregated.withColumn("stream_ms", stream).withColumn("tokens_per_second", scoring.tokens_per_second(F.col("token_count"), stream))


METRICS = "request_id string, ttft_ms double, stream_ms double, token_count bigint, response_chars bigint, tokens_per_second double, finished boolean"
STATE_BUCKETS = 2048  # keys share a state row by hash, so Python is called once per bucket and batch, not once per key
_ENTRIES = "entries binary"  # the open entries of a bucket, as an Arrow table
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(STATE_BUCKETS)).cast("int")


def _entries(state: GroupState) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(state.get[0]).read_all().to_pandas()] if state.exists else []


def _keep(state: GroupState, entries: pd.DataFrame) -> None:
    """Stores the entries of a bucket, with a timer at the first of their deadlines (``deadline``, ms)."""
    if not len(entries):
        if state.exists:
            state.remove()
        return
    table, sink = pa.Table.from_pandas(entries, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(entries["deadline"].min())))


_FOLD = {"start": "min", "first": "min", "last": "max", "n": "sum", "chars": "sum", "done": "max", "seen": "max", "deadline": "max"}


def _fold(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True).groupby("request_id", dropna=False, sort=False, as_index=False).agg(_FOLD)


def request_metrics(events: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """One row per request as soon as its ``[DONE]`` arrives, or after the time-out.

    events: request_id, ts (watermarked), data. State per request is its id and six numbers; requests
    share state rows by hash, and those that are open go on or time out one by one.
    """
    routed = route_events(events).select("request_id", "ts", "kind", F.length("content").cast("bigint").alias("chars"), _bucket("request_id").alias("__bucket"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentWatermarkMs(), _entries(state)
        for pdf in () if state.hasTimedOut else batches:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            token = pdf["kind"] == "content"
            rows = pd.DataFrame({
                "request_id": pdf["request_id"].astype(object), "start": us, "first": us.where(token, _HIGH), "last": us.where(token, _LOW), "n": token.astype("int64"),
                "chars": pdf["chars"].where(token, 0).fillna(0).astype("int64"), "done": pdf["kind"] == "done", "seen": True, "deadline": _LOW})
            held = [_fold([*held, rows])] if len(rows) else held
        if not held:
            return
        d = held[0]
        # only requests with new events start their time anew
        fresh = np.maximum(now, d["start"] // 1000) + timeout_ms
        d["deadline"] = d["deadline"].where(~d["seen"], fresh)
        over = d["done"] | (~d["seen"] & (d["deadline"] < now))
        _keep(state, d[~over].assign(seen=False))
        ended = d[over]
        if not len(ended):
            return
        stream, wait = [], []
        for start, first, last, n in zip(*(ended[c].tolist() for c in ("start", "first", "last", "n"))):
            stream.append((last - first) / 1000.0 if n else 0.0)
            wait.append((first - start) / 1000.0 if n else None)
        yield pd.DataFrame({
            "request_id": ended["request_id"].where(ended["request_id"].notna(), None).to_numpy(), "ttft_ms": pd.Series(wait, dtype="float64"), "stream_ms": stream,
            "token_count": ended["n"].to_numpy(), "response_chars": ended["chars"].to_numpy(),
            "tokens_per_second": [n / (s / 1000.0) if s > 0 else 0.0 for n, s in zip(ended["n"].tolist(), stream)], "finished": ended["done"].to_numpy()})

    return routed.groupBy("__bucket").applyInPandasWithState(step, METRICS, _ENTRIES, "append", GroupStateTimeout.EventTimeTimeout)


LOG_FIELDS = ("requestId string, timestamp timestamp, model string, userId string, ragTotalTimeMs bigint, llmTtftMs bigint, llmTotalTimeMs bigint, "
              "totalRequestTimeMs bigint, tokenCount bigint, tokensPerSecond double, responseCharCount bigint, queryLength int, ragChunksRetrieved int")


def metric_log_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of ``[METRICS_JSON] {…}`` log lines; other lines are dropped."""
    body = F.nullif(F.regexp_extract(line, r"\[METRICS_JSON\] (\{.*\})", 1), F.lit(""))
    return lines.select(F.from_json(body, LOG_FIELDS).alias("m")).where(F.col("m.requestId").isNotNull()).select("m.*")


def windowed(events: DataFrame, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Count, sum and maximum per event-time window (tumbling, or sliding with ``slide``)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("__w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest")) \
        .select(F.col("__w.start").alias("window_start"), *keys, "n", "total", "highest")


def session_activity(messages: DataFrame, session: str, ts: str = "ts") -> DataFrame:
    """Last activity and number of messages per session, maintained on every insert."""
    return messages.groupBy(session).agg(F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("n_messages"))


def unseen(texts: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "10 minutes") -> DataFrame:
    """First row of a key within its time to live: only what a cache does not hold is computed again."""
    return texts.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def _as_text(c: str, kind: T.DataType) -> Column:
    """A key column as text that tells its value exactly: pandas has no integers with nulls."""
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType)) else F.col(c).cast("string")


def _from_text(c: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(c)
    return F.from_json(c, kind) if isinstance(kind, (T.StructType, T.ArrayType)) else F.col(c).cast(kind)


def unseen_within(texts: DataFrame, keys: list[str], ttl_us: int, ts: str = "ts") -> DataFrame:
    """Rows whose key no cache holds: (keys, ts) of the first row of a key, and of the first one at
    least ``ttl_us`` after the one that was computed last.

    ``texts`` has its watermark. A hit does not lengthen an entry's life. The state of a key is the
    key and two numbers and ends with the entry, by a timer in event time; keys share state rows by hash.
    """
    names = [f"__key_{i}" for i in range(len(keys))]
    fields = ", ".join(f"`{n}` string" for n in names) + ", `__at` timestamp"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = [held.assign(fresh=False) for held in _entries(state)]
        for pdf in () if state.hasTimedOut else batches:
            us = pdf["__at"].astype("datetime64[us]").astype("int64")
            parts.append(pdf[names].astype(object).assign(us=us, deadline=_LOW, fresh=True))
        if not parts:
            return
        d = pd.concat(parts, ignore_index=True)
        if not len(d):
            return
        code = d.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
        us, fresh = d["us"].to_numpy(), d["fresh"].to_numpy()
        # an entry before its new rows, rows without time last
        order = np.lexsort((np.where(us == _LOW, _HIGH, us), fresh, code))
        edges = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True]).tolist()
        times, new, deadline = us[order].tolist(), fresh[order].tolist(), d["deadline"].to_numpy()[order].tolist()
        found, kept, kept_us, until = [], [], [], []
        for a, b in zip(edges, edges[1:]):
            at, i, end = (None, a, deadline[a]) if new[a] else (times[a], a + 1, deadline[a])
            last = b
            while last > i and times[last - 1] == _LOW:
                last -= 1
            if i < b:
                if at is None:
                    at = times[i]
                    found.append(i)
                    i += 1
                while (i := bisect_left(times, at + ttl_us, min(i, last), last)) < last:
                    at = times[i]
                    found.append(i)
                    i += 1
                end = max(now + 1, (at + ttl_us) // 1000)
            elif end < now:
                continue
            kept.append(a)
            kept_us.append(at)
            until.append(end)
        _keep(state, d[names].iloc[order[kept]].assign(us=np.array(kept_us, np.int64), deadline=np.array(until, np.int64)))
        if found:
            hits = d[names].iloc[order[found]].reset_index(drop=True)
            yield hits.where(hits.notna(), None).assign(__at=us[order[found]].astype("datetime64[us]"))

    kinds = {k: texts.schema[k].dataType for k in keys}
    rows = texts.select(*[_as_text(k, kinds[k]).alias(n) for k, n in zip(keys, names)], F.col(ts).alias("__at"))
    got = rows.withColumn("__bucket", _bucket(*names)).groupBy("__bucket").applyInPandasWithState(step, fields, _ENTRIES, "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(*[_from_text(n, kinds[k]).alias(k) for k, n in zip(keys, names)], F.col("__at").alias(ts))


def of_session(inserts: DataFrame, session: str, column: str = "chat_session_id") -> DataFrame:
    """Insert feed of one session."""
    return inserts.where(F.col(column) == session)
