"""Choosing the documents worth searching for a question.

Points are a matrix product: a question has a column for every term and phrase it holds, a
document the points it gives for them. Documents stay where they are; each task finds the asked
terms in its documents' words, multiplies for one owner after the other, and hands on the best
documents of every question. Questions of one owner with equal texts are worked out once. What
is sent to tasks is cut into blocks of questions of bounded size.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexloom import vocab
from lexloom.functions import text as T
from lexloom.operators.ordered import top_k
from lexloom.session import checkpoint

MAX_SCAN_TERMS = 1_000_000  # no longer read: any number of terms is found in one way
BLOCK_CELLS = 8 << 20  # cells of a block's question matrix, 4 bytes each
_SLICE_BYTES = 8 << 20
_POINT_CELLS = 16 << 20  # cells of a part's points, 4 bytes each
_SCORE_CELLS = 1 << 20  # (question, document) scores worked on at once

# fixed values: points per kind of match
NAME_POINTS, TEXT_POINTS = 10, 5
PHRASE_NAME_POINTS, PHRASE_TEXT_POINTS = 20, 15
CORE_ARTICLE_POINTS, CORE_POINTS, REGULATION_POINTS = 50, 5, 30


def _terms(question: Column) -> Column:
    stop = vocab.PREFILTER_STOP_WORDS
    return F.filter(F.split(F.lower(question), T.WS), lambda w: (F.length(w) > 2) & ~w.isin(*stop))


class _Terms:
    """Finds strings without blanks inside words: windows of every asked length, by hash."""

    def __init__(self, terms: list[str]):
        data = [t.encode() for t in terms]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(d) for d in data}:
            mine = np.array([i for i, d in enumerate(data) if len(d) == n], np.int64)
            hashed = np.array([self._hash(np.frombuffer(data[i], np.uint8), n)[0] for i in mine], np.uint64)
            order = np.argsort(hashed, kind="stable")
            self.by_length[n] = hashed[order], mine[order]

    @staticmethod
    def _hash(data: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + data[k:k + len(total)].astype(np.uint64) + np.uint64(1)
        return total ^ (total >> np.uint64(29))

    def inside(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) pairs, each once, for lower-case texts."""
        lists = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\s\x{a0}]+")
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        pair = np.unique(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy().astype(np.int64))
        row, word = np.divmod(pair, max(1, len(coded.dictionary)))
        words = [w.encode() + b"\n" for w in coded.dictionary.to_pylist()]
        ends = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)  # every distinct word once; no term holds the mark between them
        found_word, found_term = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (hashed, terms) in self.by_length.items():
            at = self._hash(data, n)
            spot = np.searchsorted(hashed, at)
            hit = np.flatnonzero(hashed[np.minimum(spot, len(hashed) - 1)] == at)
            found_word.append(np.searchsorted(ends, hit, side="right") - 1)
            found_term.append(terms[spot[hit]])
        found = np.unique(np.concatenate(found_word) * (1 << 32) + np.concatenate(found_term))
        held, term = found >> 32, found & 0xFFFFFFFF
        low, high = np.searchsorted(held, word), np.searchsorted(held, word, side="right")
        size = high - low
        spot = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.unique(np.repeat(row, size) * (1 << 32) + term[spot])
        return both >> 32, both & 0xFFFFFFFF


_BLOCK_COLUMNS = ["low_name", "low_text", "phrases", "core", "regulation"]


def _phrase_points(name: Column, body: Column) -> Column:
    """Points a document gives for each fixed phrase."""
    def points(p):
        # a phrase in a name may be written with its first blank as a hyphen or underscore
        forms = sorted({p, p.replace(" ", "-", 1), p.replace(" ", "_", 1)})
        in_name = F.lit(False)
        for form in forms:
            in_name = in_name | name.contains(form)
        return F.when(in_name, PHRASE_NAME_POINTS).otherwise(0) + F.when(body.contains(p), PHRASE_TEXT_POINTS).otherwise(0)
    return F.array(*[points(p) for p in vocab.PREFILTER_PHRASES])


def _scored(questions: list, owners: dict, terms: list[str], max_docs: int, positive: bool, article_points: bool, arrow: pa.Schema):
    """Task that scores its documents for a block of questions and hands on the best of each."""
    code = {t: i for i, t in enumerate(terms)}
    width = len(terms) + len(vocab.PREFILTER_PHRASES) + 3
    matrix = np.zeros((len(questions), width), np.float32)
    for i, (mine, phrases, article) in enumerate(questions):
        for t, n in mine.items():
            matrix[i, code[t]] = n
        matrix[i, len(terms):width - 3] = phrases
        matrix[i, width - 3:] = (1, 0, 0) if not (article and article_points) else (0, 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, best = _Terms(terms), {}
        for whole in batches:
            for batch in _slices(whole, max(1, _POINT_CELLS // width)):
                points = np.zeros((batch.num_rows, width), np.float32)
                for column, worth in (("low_name", NAME_POINTS), ("low_text", TEXT_POINTS)):
                    row, term = finder.inside(batch[column])
                    points[row, term] += worth
                points[:, len(terms):width - 3] = batch["phrases"].flatten().to_numpy().reshape(batch.num_rows, -1)
                core, regulation = (batch[c].to_numpy(zero_copy_only=False).astype(np.float32) for c in ("core", "regulation"))
                points[:, width - 3], points[:, width - 2], points[:, width - 1] = core * CORE_POINTS, core * CORE_ARTICLE_POINTS, regulation * REGULATION_POINTS
                coded = batch["owner"].dictionary_encode()
                for number, owner in enumerate(coded.dictionary.to_pylist()):
                    mine = owners.get(owner)
                    if mine is None:
                        continue
                    docs = np.flatnonzero(coded.indices.to_numpy(zero_copy_only=False) == number)
                    pos = batch["pos"].to_numpy(zero_copy_only=False).astype(np.int64)[docs]
                    order = np.argsort(pos, kind="stable")
                    docs, pos = docs[order], pos[order]
                    ids = np.array(batch["document_id"].to_pylist(), dtype=object)[docs]
                    step = max(max_docs, _SCORE_CELLS // len(mine))
                    for a in range(0, len(docs), step):
                        score = (matrix[mine] @ points[docs[a:a + step]].T).astype(np.int64)
                        best[owner] = _merge(best.get(owner), score, pos[a:a + step], ids[a:a + step], max_docs)
        for owner, (score, pos, ids) in best.items():
            keep = score > (0 if positive else -1)
            number = np.repeat(np.array(owners[owner]), keep.sum(axis=1))
            if len(number):
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(ids[keep].tolist(), arrow.field(1).type),
                                                  pa.array(pos[keep]), pa.array(score[keep])], schema=arrow)
    return run


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of about _SLICE_BYTES of text and at most ``rows`` rows."""
    size = pc.fill_null(pc.binary_length(batch["low_text"]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // _SLICE_BYTES
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if batch.num_rows else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        for c in range(int(a), int(b), rows):
            yield batch.slice(c, min(rows, int(b) - c))


def _merge(old, score, pos, ids, k):
    """The k best columns of every row: high scores first, then low positions.

    The new columns come in the order of their positions, so a column's number breaks ties.
    """
    n = score.shape[1]
    at = np.broadcast_to(np.arange(n), score.shape)
    if n > k:
        at = np.sort(np.argpartition(score * -n + at, k - 1, axis=1)[:, :k], axis=1)
    score, pos, ids = np.take_along_axis(score, at, axis=1), pos[at], ids[at]
    if old is not None:
        score, pos, ids = (np.concatenate(x, axis=1) for x in zip(old, (score, pos, ids)))
    order = np.lexsort((pos, -score), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (score, pos, ids))


def score_documents(questions: DataFrame, documents: DataFrame, max_docs: int, core: Column, regulation: Column,
                    positive: bool = True, article_points: bool = True) -> DataFrame:
    """(owner, question, document_id, pos, score, rank): the best documents of every (owner, question).

    ``questions`` has distinct (owner, question). Without ``positive`` documents without points
    fill up the list in their order. Rows with null owner or question choose nothing.
    """
    spark = documents.sparkSession
    low = F.lower("question")
    asked = checkpoint(questions.where("owner IS NOT NULL AND question IS NOT NULL").select(
        "owner", "question", _terms(F.col("question")).alias("terms"), F.array(*[low.contains(p) for p in vocab.PREFILTER_PHRASES]).alias("phrases"),
        low.rlike(r"article\s*\d+").alias("article")), "prefilter-questions")
    body = F.lower(F.coalesce("description", F.lit("")))
    name = F.lower(F.coalesce("name", F.lit("")))
    docs = documents.where("owner IS NOT NULL").select(
        "owner", "document_id", F.col("pos").cast("long").alias("pos"), name.alias("low_name"), body.alias("low_text"), _phrase_points(name, body).alias("phrases"),
        F.coalesce(core, F.lit(False)).alias("core"), F.coalesce(regulation, F.lit(False)).alias("regulation"))
    schema = f"question_no int, document_id {documents.schema['document_id'].dataType.simpleString()}, pos bigint, score bigint"
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = pa.schema([("question_no", pa.int32()), ("document_id", to_arrow_type(documents.schema["document_id"].dataType)), ("pos", pa.int64()), ("score", pa.int64())])
    out = None
    for block in _blocks(asked):
        terms = sorted({t for r in block for t in r.terms})
        rows = [(Counter(r.terms), r.phrases, r.article) for r in block]
        owners: dict = {}
        for i, r in enumerate(block):
            owners.setdefault(r.owner, []).append(i)
        found = checkpoint(docs.mapInArrow(_scored(rows, owners, terms, max_docs, positive, article_points, arrow), schema), "prefilter-scores")
        best = top_k(found, ["question_no"], [F.col("score").desc(), F.col("pos")], max_docs)
        named = spark.createDataFrame([(i, r.owner, r.question) for i, r in enumerate(block)], "question_no int, owner " + asked.schema["owner"].dataType.simpleString() + ", question string")
        part = best.join(named, "question_no").drop("question_no")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = asked.select("owner", "question").join(docs.select("owner", "document_id", "pos").limit(0), "owner").withColumns({"score": F.lit(0).cast("bigint"), "rank": F.lit(1)})
    return out.select("owner", "question", "document_id", "pos", "score", "rank")


def _blocks(asked: DataFrame):
    """Questions whose matrix has at most BLOCK_CELLS cells together (or one question)."""
    block, terms, fixed = [], set(), len(vocab.PREFILTER_PHRASES) + 3
    for row in asked.toLocalIterator():
        more = terms | set(row.terms)
        if block and (len(block) + 1) * (len(more) + fixed) > BLOCK_CELLS:
            yield block
            block, more = [], set(row.terms)
        block.append(row)
        terms = more
    if block:
        yield block


def is_core(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("federal-decree-law") | (low.contains("corporate tax") & low.contains("general"))


def is_core_without_bonus(name: Column) -> Column:
    """The main law, as the variant that keeps documents without points knows it."""
    low = F.lower(name)
    return low.contains("federal-decree-law-no.-47") | low.contains("federal decree-law")


def scored_documents(questions: DataFrame, documents: DataFrame, max_docs: int = 10) -> DataFrame:
    """Variant without fallbacks: the first ``max_docs`` documents by points, those without points too.

    (query_id, document_id, score, rank); questions and documents as in ``prefilter_documents``.
    """
    best = score_documents(questions.select("owner", "question").distinct(), documents, max_docs, is_core_without_bonus(F.col("name")), F.lit(False), False, False)
    return questions.join(best, ["owner", "question"]).select("query_id", "document_id", "score", F.col("rank").cast("bigint").alias("rank"))


def prefilter_documents(questions: DataFrame, documents: DataFrame, max_docs: int = 10) -> DataFrame:
    """Up to ``max_docs`` documents per question: (query_id, document_id, score, rank).

    questions: owner, query_id, question; documents: owner, document_id, pos, name, description.
    Core laws gain points for every question, many when it names an article. A question
    naming an article with under three documents is topped up with core documents; one
    without any document takes up to five core documents, or the owner's first ones.
    """
    # read by every step below
    qs = checkpoint(questions.withColumn("__article", F.lower("question").rlike(r"article\s*\d+")), "prefilter-questions")
    name = F.lower("name")
    best = score_documents(qs.select("owner", "question").distinct(), documents, max_docs, is_core(F.col("name")), name.contains("executive regulation"))
    # read four times below
    chosen = checkpoint(qs.join(best, ["owner", "question"]).select("query_id", "document_id", "score", "rank"), "prefilter")

    have = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("__have"))
    counted = qs.join(have, "query_id", "left").withColumn("__have", F.coalesce("__have", F.lit(0)))
    law = documents.where(name.contains("federal-decree-law") | name.contains("executive regulation"))
    law = top_k(law, ["owner"], [F.col("pos")], max_docs + 3, "__n").select("owner", "document_id", "pos")
    short = counted.where(F.col("__article") & (F.col("__have") < 3)).select("owner", "query_id", "__have")
    topped = short.join(law, "owner").join(chosen.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti")
    topped = top_k(topped, ["query_id"], [F.col("pos")], max_docs, "__n").where(F.col("__have") + F.col("__n") <= max_docs) \
        .select("query_id", "document_id", F.lit(0).cast("bigint").alias("score"), (F.col("__have") + F.col("__n")).alias("rank"))
    chosen = chosen.select("query_id", "document_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank")) \
        .unionByName(topped.withColumn("rank", F.col("rank").cast("bigint")))

    none = qs.join(chosen.select("query_id").distinct(), "query_id", "left_anti").select("owner", "query_id")
    fall = documents.where(name.contains("corporate tax") | name.contains("federal-decree-law"))
    fall = top_k(fall, ["owner"], [F.col("pos")], 5).select("owner", "document_id", "rank")
    first = top_k(documents, ["owner"], [F.col("pos")], max_docs).select("owner", "document_id", "rank") \
        .join(fall.select("owner").distinct(), "owner", "left_anti")
    rest = none.join(fall.unionByName(first), "owner").select("query_id", "document_id", F.lit(0).cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))
    return chosen.unionByName(rest)


def add_missing_core(selected: DataFrame, core: DataFrame) -> DataFrame:
    """Core documents (query_id, document_id) a selection lacks are appended to it."""
    return selected.unionByName(core.join(selected, ["query_id", "document_id"], "left_anti"), allowMissingColumns=True)
