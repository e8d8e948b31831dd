"""Small scoring rules shared by search, reranking and reports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def rrf_term(rank: Column, k: int = 60, weight: float = 1.0) -> Column:
    """``weight / (k + rank)``; 0 when the row is not ranked in that list."""
    return F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + rank), F.lit(0.0))


def rank_decay(rank: Column) -> Column:
    """1, 0.9, 0.8 … by rank from 1."""
    return 1.0 - (rank - 1) * 0.1


def recency_weighted(similarity: Column, created: Column, now: Column, weight: float = 0.3, half_hours: float = 168.0) -> Column:
    """Similarity mixed with an exponential decay of the age in hours."""
    age_h = (F.unix_micros(now) - F.unix_micros(created)) / 3.6e9
    return (1.0 - weight) * similarity + weight * F.exp(-age_h / half_hours)


def interest_boost(score: Column, text: Column, topics: Column, factor: float = 1.5) -> Column:
    """Score times ``factor`` for every topic the text mentions."""
    hits = F.size(F.filter(topics, lambda t: F.lower(text).contains(F.lower(t))))
    return score * F.pow(F.lit(float(factor)), hits)


def tokens_per_second(count: Column, millis: Column) -> Column:
    return F.when(millis > 0, count / (millis / 1000.0)).otherwise(F.lit(0.0))


def first_of(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    """``when`` chain from (condition, value) pairs."""
    if not pairs:
        return default
    head, *rest = pairs
    return reduce(lambda acc, p: acc.when(p[0], p[1]), rest, F.when(head[0], head[1])).otherwise(default)


def expires_at(created: Column, hours: int = 1) -> Column:
    return created + F.expr(f"INTERVAL {int(hours)} HOURS")


def iso_timestamp(ts: Column) -> Column:
    """ISO text with milliseconds and a Z, as stored in status columns."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
