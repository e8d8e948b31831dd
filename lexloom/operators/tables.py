"""Reads and writes of the document, chat and profile tables as set operations.

Updates return the new table state; the caller writes it. ``ts`` orders events of a key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexloom import vocab
from lexloom.functions import text as T
from lexloom.operators import ordered
from lexloom.operators.ordered import top_k

TERMINAL = ["completed", "failed"]


# ------------------------------------------------------------------ reads

def owned(df: DataFrame, user: Column | str, column: str = "user_id") -> DataFrame:
    return df.where(F.col(column) == user)


def newest_first(df: DataFrame, ts: str, limit: int | None = None) -> DataFrame:
    """Rows by time descending; a limited list is a top-k and needs no full sort."""
    out = df.orderBy(F.col(ts).desc())
    return out.limit(limit) if limit is not None else out


def recent_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of every key."""
    return top_k(df, keys, order, n)


def children_of(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is among ``parents``."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def name_contains(df: DataFrame, column: str, needle: str) -> DataFrame:
    return df.where(F.lower(column).contains(needle.lower()))


def optional_types(df: DataFrame, column: str, types: list[str] | None = None, tables: bool = True, table_flag: str | None = None) -> DataFrame:
    """Rows of the given types, all without a list; table rows only when asked for."""
    out = df.where(F.col(column).isin(*types)) if types is not None else df
    return out if tables or table_flag is None else out.where(~F.col(table_flag))


def between_times(df: DataFrame, ts: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Inclusive range; a missing bound is open."""
    out = df if start is None else df.where(F.col(ts) >= start)
    return out if end is None else out.where(F.col(ts) <= end)


def message_rows(messages: DataFrame) -> DataFrame:
    """Stored messages with their sources taken out of the VARIANT metadata."""
    return messages.withColumn("sources", F.try_variant_get("metadata", "$.sources", "string")).drop("metadata")


def as_of(probes: DataFrame, events: DataFrame, key: str, ts: str, state: str, out: str = "state", bucket: Column | None = None) -> DataFrame:
    """State of each probe's key by its last event at or before the probe.

    Probes and events are merged and the state carried forward, so no event meets a probe twice.
    """
    e = events.select(key, ts, F.lit(0).alias("__kind"), F.col("event_id").alias("__id"), F.col(state).alias("__state"))
    p = probes.select(key, ts, F.lit(1).alias("__kind"), F.lit(0).cast("bigint").alias("__id"), F.lit(None).cast(events.schema[state].dataType).alias("__state"))
    merged = ordered.carry(e.unionByName(p), [key], [ts, "__kind", "__id"], F.col("__state"), out, bucket)
    return merged.where(F.col("__kind") == 1).select(key, ts, out)


# ------------------------------------------------------------------ writes

def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_search_tokens(df: DataFrame, text: str = "content") -> DataFrame:
    """Derived token column, filled for every row at write time."""
    return df.withColumn("tokens", T.tokens(F.col(text)))


def fold_feedback(events: DataFrame, keys: list[str], first: list[str], last: list[str], order: list[str]) -> DataFrame:
    """One row per key: ``first`` fields of its first event, ``last`` fields of its latest."""
    at = F.struct(*order)
    lead, tail = F.min_by(F.struct(*first), at), F.max_by(F.struct(*last), at)
    out = events.groupBy(*keys).agg(lead.alias("__first"), tail.alias("__last"))
    return out.select(*keys, "__first.*", "__last.*")


def merge_feedback(target: DataFrame, folded: DataFrame, keys: list[str], last: list[str]) -> DataFrame:
    """Target after a batch: known keys change only ``last`` fields, new keys are added whole."""
    changes = folded.select(*keys, *[F.col(c).alias(f"__{c}") for c in last], F.lit(True).alias("__hit"))
    kept = target.join(changes, keys, "left")
    kept = kept.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in last}).select(*target.columns)
    return kept.unionByName(folded.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def fold_status(events: DataFrame, key: str, status: str, ts: str, event_id: str, bucket: Column | None = None, terminal: list[str] = TERMINAL,
                extra: tuple[str, ...] = ()) -> DataFrame:
    """status = latest; processed_at = first entry into a terminal status from another one;
    ``extra`` columns (error text, chunk count) keep their latest non-null value."""
    order = [ts, event_id]
    prev = ordered.previous_row(events, [key], order, [status], "__prev", bucket)
    enters = F.col(status).isin(*terminal) & ~F.coalesce(F.col(f"__prev.{status}").isin(*terminal), F.lit(False))
    return prev.groupBy(key).agg(
        F.max_by(status, F.struct(*order)).alias("status"), F.min(F.when(enters, F.col(ts))).alias("processed_at"), F.count(F.lit(1)).alias("n_updates"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in extra])


def cascade_delete(tables: list[tuple[DataFrame, str]], removed: DataFrame, key: str) -> list[DataFrame]:
    """Parent and child tables without the rows of the removed keys."""
    gone = removed.select(F.col(key).alias("__gone")).distinct()
    return [df.join(gone, F.col(column) == F.col("__gone"), "left_anti") for df, column in tables]


def ensure_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, email, full_name, is_new) of every user; the name falls back to the e-mail's local part."""
    name = F.coalesce(F.nullif("full_name", F.lit("")), F.split_part("email", F.lit("@"), F.lit(1)))
    known = profiles.select("id", F.lit(True).alias("__known"))
    return users.withColumn("full_name", name).join(known, "id", "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


def find_or_create(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that are missing by key: what has to be inserted."""
    return wanted.join(existing.select(*keys).distinct(), keys, "left_anti")


def patch(target: DataFrame, updates: DataFrame, keys: list[str], fields: list[str], touched: str | None = None, now: Column | None = None) -> DataFrame:
    """Non-null fields of an update replace the old ones; updated rows get a new timestamp."""
    u = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    out = target.join(u, keys, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields})
    if touched:
        out = out.withColumn(touched, F.when(F.col("__hit"), now).otherwise(F.col(touched)))
    return out.select(*target.columns)


# ------------------------------------------------------------------ numbers

def corpus_stats(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: pages, pages with text, characters, tokens, chunks, mean chunk size, embedding cost."""
    text = F.col("text")
    p = pages.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.trim(text) != "").alias("n_with_text"), F.sum(F.length(text).cast("bigint")).alias("chars"),
                  F.sum(T.estimate_tokens(text)).alias("tokens"))
    c = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("content")), 6).alias("avg_chunk"))
    cost = F.round(F.col("tokens") * vocab.EMBEDDING_PRICE_PER_TOKEN, 9)
    return p.withColumn("n_chunks", c.select("n_chunks").scalar()).withColumn("avg_chunk", c.select("avg_chunk").scalar()).withColumn("embedding_cost", cost)


def token_costs(usage: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Adds cost in USD by the price list; unknown models cost as the default one."""
    def price(i):
        by_model = F.create_map(*[x for row in vocab.MODEL_PRICES for x in (F.lit(row[0]), F.lit(row[i]))])
        default = next(r[i] for r in vocab.MODEL_PRICES if r[0] == vocab.DEFAULT_PRICE_MODEL)
        return F.coalesce(F.try_element_at(by_model, F.col(model)), F.lit(default))
    return usage.withColumn("cost", F.col(tokens_in) * price(1) + F.col(tokens_out) * price(2))
