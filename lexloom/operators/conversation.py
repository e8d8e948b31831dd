"""Messages of conversations: histories, context of a turn, token budgets, response timing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexloom.functions import query as Q, scoring
from lexloom.operators import ordered

TURNS = 512  # turns of a conversation per bucket


def _bucket(turn: str) -> Column:
    return F.floor(F.col(turn) / TURNS)


def recent_messages(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The latest n messages of each conversation; column recency counts back from 1."""
    return ordered.top_k(messages, [conv], [F.col(turn).desc()], n, "recency")


def prior_user_turn(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """prior_user: text of the user message before each message."""
    user = F.when(F.col("role") == "user", F.col("text"))
    return ordered.carry(messages, [conv], [turn], user, "prior_user", _bucket(turn), inclusive=False)


def token_window(messages: DataFrame, limit: int, tokens: Column, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The longest run of latest messages within a token limit; adds tokens and tokens_kept."""
    d = messages.withColumn("tokens", tokens)
    summed = ordered.running_sum(d, [conv], [turn], F.col("tokens"), "tokens_kept", _bucket(turn), descending=True)
    return summed.where(F.col("tokens_kept") <= limit)


def with_context(messages: DataFrame, n: int = 4, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """context: the n messages before each message, joined by blanks; question: the enriched text of follow-ups."""
    d = ordered.preceding_rows(messages, [conv], [turn], F.col("text"), n, "__before", _bucket(turn))
    context = F.array_join("__before", " ")
    question = F.when(Q.is_follow_up(F.col("text")), Q.enrich_query(F.col("text"), context)).otherwise(F.col("text"))
    return d.withColumn("context", context).withColumn("question", question).drop("__before")


def request_timing(events: DataFrame, request: str, ts: str, started: Column | None = None) -> DataFrame:
    """Per request: ttft_ms from the start to the first token, stream_ms from first to last, token rate.

    One mergeable aggregation; ``started`` is the request's start where events carry it.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = F.min(micros), F.max(micros)
    start = F.min(F.unix_micros(started.cast("timestamp"))) if started is not None else first
    out = events.groupBy(request).agg(first.alias("__f"), last.alias("__l"), start.alias("__s"), F.count(F.lit(1)).alias("token_count"))
    stream = (F.col("__l") - F.col("__f")) / 1000.0
    return out.select(request, "token_count", ((F.col("__f") - F.col("__s")) / 1000.0).alias("ttft_ms"), stream.alias("stream_ms"),
                      scoring.tokens_per_second(F.col("token_count"), stream).alias("tokens_per_second"))


def timing_report(timings: DataFrame, keys: list[str], value: str, width: float, approx: bool = False) -> DataFrame:
    """min, avg, max and P50/P95 of a measure; exact by value counts, or approximate."""
    basic = [F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("avg"), F.max(value).alias("max")]
    if approx:
        return timings.groupBy(*keys).agg(*basic, F.percentile_approx(value, 0.5, 10000).alias("p50"), F.percentile_approx(value, 0.95, 10000).alias("p95"))
    exact = ordered.percentiles(timings, keys, value, {"p50": 0.5, "p95": 0.95}, width)
    return timings.groupBy(*keys).agg(*basic).join(exact, keys)
