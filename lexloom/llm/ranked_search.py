"""Ranks all documents for many texts at once, by integer BM25 over their terms.

Accumulator-limited term-at-a-time: a text's terms are taken rarest first, each adding to the
accumulators of the documents that hold it. Once the terms left cannot lift a new document to
the k-th partial score, no accumulator is created any more and the present ones are completed
exactly, so the ranking is that of a full evaluation.

Documents are read once into an index of postings by slice of text, on shared storage. A first
round adds up every text's rarest terms in all slices and reduces their k best partial scores to
one score per text: the point all tasks start from. A second round ranks, each task handing on k
documents a text. Texts are handled in blocks of at most BLOCK_TERMS terms (or one text), which
bounds what a task is given; the corpus is never joined or shuffled.

Defined cases: a null text has no terms, and a text without terms ranks nothing. Rows that repeat
an item_id are ranked each by itself. Rows that repeat a doc_id are documents of their own, those
without doc_id stand behind equal scores. Empty tables give an empty result. Only the columns
item_id, doc_id and text are read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexloom.llm import words
from lexloom.operators.ordered import top_k
from lexloom.session import checkpoint

K = 50
BLOCK_TERMS = 100_000  # distinct terms per text, summed over the texts of a block
SLICE_BYTES = 2 << 20  # text per row of the index
FIRST_POSTINGS = 20  # the first round takes terms until they have this many postings per place of the ranking
_INDEX = "doc_ids array<bigint>, lengths array<bigint>, terms array<int>, starts array<int>, docs array<int>, counts array<bigint>"
_NO_BOUND = (1 << 63) - 1
_ROUND = "item int, term int, value bigint"
_RANKED = "item int, item_id bigint, doc_id bigint, score bigint"

#: Every ASCII character but digits and letters ends a term; A-Z become a-z; other bytes stay.
_BYTES = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _BYTES[_b] = ord(chr(_b).lower()) if chr(_b).isalnum() else 0x20


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of every text as (codes, bounds, vocabulary), see words.split."""
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return words.split(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    mapped = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(_BYTES[raw].tobytes()))
    return words.split(mapped)


def index(docs: DataFrame, asked: list[str]) -> DataFrame:
    """Postings of the asked terms, one row per slice of documents.

    ``starts`` cuts ``docs`` (places in doc_ids) and ``counts`` by the terms of the slice;
    ``lengths`` holds the number of all terms of every document.
    """
    known = pa.array(asked, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.slices(batches, max_bytes=SLICE_BYTES):
            codes, bounds, vocabulary = split(piece.column("text"))
            asked_as = pc.fill_null(pc.index_in(vocabulary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = asked_as[codes] if len(codes) else np.zeros(0, np.int64)
            hit = term >= 0
            posting, count = np.unique(term[hit] * piece.num_rows + words.row_of(bounds)[hit], return_counts=True)
            term, doc = np.divmod(posting, piece.num_rows)
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            columns = [piece.column("doc_id").to_pylist(), np.diff(bounds), term[first].astype(np.int32),
                       np.r_[first, len(term)].astype(np.int32), doc.astype(np.int32), count.astype(np.int64)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds)], [f.split()[0] for f in _INDEX.split(", ")])
    return checkpoint(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, _INDEX), "postings")


class _Slice:
    """One row of the index with what each posting adds to a score."""

    def __init__(self, row: dict, weight: np.ndarray, n_docs: int, n_terms: int):
        ids = row["doc_ids"].values
        self.no_id = pc.is_null(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        self.terms, starts = (row[c].values.to_numpy(zero_copy_only=False) for c in ("terms", "starts"))
        self.docs, count = (row[c].values.to_numpy(zero_copy_only=False) for c in ("docs", "counts"))
        self.spans = {t: (a, b) for t, a, b in zip(self.terms.tolist(), starts[:-1].tolist(), starts[1:].tolist())}
        self.starts = starts
        damped = 50 + (50 * row["lengths"].values.to_numpy(zero_copy_only=False) * n_docs) // max(n_terms, 1)
        self.adds = weight[np.repeat(self.terms, np.diff(starts))] * ((1_000_000_000 * count) // (1000 * count + 20 * damped[self.docs]))

    def of(self, term: int):
        """(documents, what each gains) of a term."""
        a, b = self.spans.get(term, (0, 0))
        return self.docs[a:b], self.adds[a:b]


def _slices(batches, weight, n_docs, n_terms) -> Iterator[_Slice]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Slice({c: batch.column(c)[i] for c in batch.schema.names}, weight, n_docs, n_terms)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _accumulate(piece: _Slice, terms: list[int], left: list[int], start: int, k: int):
    """(touched documents, scores) of one text, terms rarest first; left[i] bounds terms i and later."""
    score = np.zeros(len(piece.ids), np.int64)
    seen = np.zeros(len(piece.ids), bool)
    reach, creating = start, True
    for i, term in enumerate(terms):
        docs, adds = piece.of(term)
        creating = creating and left[i] >= reach
        if not creating:
            old = seen[docs]
            docs, adds = docs[old], adds[old]
        score[docs] += adds
        seen[docs] = True
        if creating and len(docs):
            reach = max(reach, _kth(score[seen], k))
    return np.flatnonzero(seen), score


def _best(piece_ids, no_id, score, k):
    order = np.lexsort((piece_ids, no_id, -score))[:k]
    return piece_ids[order], no_id[order], score[order]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Texts with their distinct terms, BLOCK_TERMS terms at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        terms = split(pa.array([row.text]))[2].to_pylist()
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, terms))
        size += len(terms)
    if block:
        yield block


def _rank_block(docs: DataFrame, block: list[tuple[int, list[str]]], k: int) -> DataFrame:
    asked = sorted({t for _, terms in block for t in terms})
    code = {t: i for i, t in enumerate(asked)}
    postings = index(docs, asked)
    lengths = F.col("lengths")
    n_docs, n_terms = postings.agg(
        F.sum(F.size(F.filter(lengths, lambda n: n > 0))), F.sum(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n))).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    df = np.zeros(len(asked), np.int64)
    sizes = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("starts", i + 1) - F.get("starts", i)).alias("n")))
    for row in postings.select(F.inline(sizes)).groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row.term] = row.n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()] or [0], np.int64)
    found = [sorted((code[t] for t in terms if df[code[t]]), key=lambda t: (df[t], t)) for _, terms in block]
    first = [_rarest(terms, df, k) for terms in found]

    def opening(batches):
        best = [np.zeros(0, np.int64) for _ in found]
        top = np.zeros(len(asked), np.int64)
        for piece in _slices(batches, weight, n_docs, n_terms):
            if len(piece.adds):
                np.maximum.at(top, piece.terms, np.maximum.reduceat(piece.adds, piece.starts[:-1]))
            for item, terms in enumerate(first):
                touched, score = _accumulate(piece, terms, [_NO_BOUND] * len(terms), 0, k)
                best[item] = np.sort(np.r_[best[item], score[touched]])[-k:]
        items = np.repeat(np.arange(len(found)), [len(b) for b in best])
        terms = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[items, np.full(len(terms), -1)], pa.int32()), pa.array(np.r_[np.full(len(items), -1), terms], pa.int32()),
            pa.array(np.concatenate([*best, top[terms]]), pa.int64())], ["item", "term", "value"])

    opened = checkpoint(postings.mapInArrow(opening, _ROUND), "opening")
    most = np.zeros(len(asked), np.int64)
    for row in opened.where("term >= 0").groupBy("term").agg(F.max("value").alias("value")).collect():
        most[row.term] = row.value
    start = np.zeros(len(block), np.int64)
    for row in top_k(opened.where("item >= 0"), ["item"], [F.col("value").desc()], k).where(F.col("rank") == k).collect():
        start[row.item] = row.value
    left = [np.cumsum(most[terms][::-1])[::-1].tolist() for terms in found]
    ids = [item_id for item_id, _ in block]

    def ranking(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in found]
        for piece in _slices(batches, weight, n_docs, n_terms):
            for item, terms in enumerate(found):
                kept = best[item]
                reach = max(int(start[item]), int(kept[2][-1]) if len(kept[2]) == k else 0)
                touched, score = _accumulate(piece, terms, left[item], reach, k)
                touched = touched[score[touched] >= max(reach, 1)]
                if len(touched):
                    best[item] = _best(*(np.r_[a, b[touched]] for a, b in zip(kept, (piece.ids, piece.no_id, score))), k)
        sizes = [len(b[2]) for b in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(found)), sizes), pa.int32()), pa.array([ids[i] for i, n in enumerate(sizes) for _ in range(n)], pa.int64()),
            pa.array(np.concatenate([b[0] for b in best]), pa.int64(), mask=np.concatenate([b[1] for b in best])),
            pa.array(np.concatenate([b[2] for b in best]), pa.int64())], [f.split()[0] for f in _RANKED.split(", ")])

    ranked = checkpoint(postings.mapInArrow(ranking, _RANKED), "ranking")
    return top_k(ranked, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)


def _rarest(terms: list[int], df: np.ndarray, k: int) -> list[int]:
    """The first terms, until they have FIRST_POSTINGS * k postings together."""
    upto = np.cumsum(df[terms]) if terms else np.zeros(0)
    return terms[:int(np.searchsorted(upto, FIRST_POSTINGS * k)) + 1]


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of every text: item_id, rank (from 1), doc_id, score."""
    out = None
    for block in _blocks(items):
        found = _rank_block(docs, block, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
