"""Quality rules with verdicts on whole hosts.

Each text gets a few counts and a base verdict. Failures are counted by host, the rate of a
host is shrunk towards the rates of all hosts by a beta prior fitted to them, and hosts whose
shrunken rate is too high reject all their documents.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexloom.llm import words
from lexloom.session import checkpoint

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeated(codes: np.ndarray, bounds: np.ndarray, n_words: int) -> np.ndarray:
    """Marks the words in windows of three that occur twice or more in their row."""
    hit = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return hit
    row = words.row_of(bounds)
    start = np.flatnonzero(row[2:] == row[:-2])
    # pairs of words as dense numbers, then (row, pair, word) as dense numbers: exact, no hashing
    pair = np.unique(codes[:-1] * n_words + codes[1:], return_inverse=True)[1]
    triple = np.unique(pair[start] * n_words + codes[start + 2], return_inverse=True)[1]
    _, place, count = np.unique(row[start] * (triple.max(initial=0) + 1) + triple, return_inverse=True, return_counts=True)
    start = start[count[place] > 1]
    for k in range(3):
        hit[start + k] = True
    return hit


def _dup_lines(texts: pa.Array) -> np.ndarray:
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    ends = lines.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    row = words.row_of(ends)
    code = flat.dictionary_encode()
    filled = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(code.dictionary)), 0).to_numpy(zero_copy_only=False)
    index = code.indices.to_numpy().astype(np.int64)
    counted = filled[index] if len(index) else np.zeros(0, bool)
    key = row[counted] * (len(filled) + 1) + index[counted]
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return np.bincount(row[counted][~first], minlength=len(ends) - 1)


def _count(batches):
    for batch in words.slices(batches):
        texts = pc.fill_null(batch.column("text"), "")
        codes, bounds, vocabulary = words.split(texts)
        rows = len(bounds) - 1
        row = words.row_of(bounds)
        length = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        n_words = np.diff(bounds)
        symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]")
        columns = [
            n_words,
            np.bincount(row, weights=length[codes] if len(codes) else None, minlength=rows).astype(np.int64),
            symbols.to_numpy(zero_copy_only=False).astype(np.int64),
            _dup_lines(texts),
            np.bincount(row[_repeated(codes, bounds, len(vocabulary) + 1)], minlength=rows),
        ]
        names = [f.split()[0] for f in _COUNTS.split(", ")]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in kept] + [pa.array(c.astype(np.int64)) for c in columns], names=kept + names)


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts of every text and its base verdict: (doc_id, source, n_words, ..., base_failed)."""
    counted = docs.select("doc_id", "source", "text").mapInArrow(
        _count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source {docs.schema['source'].dataType.simpleString()}, {_COUNTS}")
    return counted.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: (source, n_docs, n_failed, host_rate, host_failed).

    The prior is a beta distribution with the mean and spread of the hosts' own rates, the
    spread freed of the binomial noise expected at each host's size. Hosts that all behave
    alike leave no spread: then every host gets the common rate.
    """
    hosts = counts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.avg(rate).alias("mean"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"),
        F.avg(1 / F.col("n_docs")).alias("noise"))
    # total weight of the prior: mean * (1 - mean) / variance - 1, variance = spread - mean (1 - mean) noise
    room = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("spread") - room * F.col("noise"), room * F.lit(1e-6))
    prior = moments.select("mean", F.when(room > 0, F.greatest(room / between - 1, F.lit(0.0))).otherwise(F.lit(0.0)).alias("weight"))
    judged = hosts.join(F.broadcast(prior))  # one row
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return judged.select("source", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    ``docs`` needs doc_id, text and source (the host). A null or empty text has no words and
    fails the base rules; documents without source form one host of their own; repeated rows
    are judged and counted one by one; other columns are left out; an empty table gives none.
    """
    counts = checkpoint(text_counts(docs), "counts")  # read twice, small beside the texts
    hosts = host_verdicts(counts, max_rate).select(F.col("source").alias("__host"), "host_rate", "host_failed")
    joined = counts.join(hosts, F.col("source").eqNullSafe(F.col("__host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rate")
