"""Where passages stand in pages: all pairs of two tables, by every attempt.

Every attempt looks for a phrase of its own. Phrases meet pages by winnowed anchors: of each run of SPAN neighbouring ANCHOR-byte pieces of a text
the one with the smallest hash is an anchor. Whatever stretch of ANCHOR + SPAN - 1 bytes two
texts share, they share its anchors. A phrase joins the pages through its rarest anchor alone, so
boilerplate in a phrase is no key unless all of it is boilerplate. Phrases shorter than a run
are keys by themselves. A phrase that may be in a page is looked for in the whole page, once for
all passages that have it, and the strictest attempt that hits is a pair's place.

Anchors of passages go to tasks in blocks of bounded size; pages hand on the asked anchors only.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexloom.functions import text as T
from lexloom.operators.rows import computed
from lexloom.session import checkpoint

ANCHOR, SPAN = 8, 9
RUN = ANCHOR + SPAN - 1
BLOCK_ANCHORS = 4 << 20  # anchors shown to a task at once, 8 bytes each
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _pieces(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` bytes (up to 15)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    head, tail = np.zeros(n, _U64), np.zeros(n, _U64)
    for k in range(width):
        part = data[k:k + n].astype(_U64) << _U64(8 * (k % 8))
        if k < 8:
            head |= part
        else:
            tail |= part
    return _mix(head ^ _mix(tail + _U64(width)))


def anchors(text: str, widths: list[int]) -> np.ndarray:
    """Distinct anchors of a text, and the hashes of all its pieces of the given short widths."""
    data = np.frombuffer(text.encode(), np.uint8)
    pieces = _pieces(data, ANCHOR)
    found = [_pieces(data, w) for w in widths]
    if len(pieces) >= SPAN:
        n = len(pieces) - SPAN + 1
        least = pieces[:n].copy()
        for k in range(1, SPAN):
            np.minimum(least, pieces[k:k + n], out=least)
        found.append(least)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, _U64)


def _phrase_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for phrase in batch.column("phrase").to_pylist():
            short = len(phrase.encode()) < RUN
            data = np.frombuffer(phrase.encode(), np.uint8)
            found.append(_pieces(data, len(data)) if short else anchors(phrase, []))
        sizes = [len(f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("phrase"), pa.array([len(p.encode()) if len(p.encode()) < RUN else 0 for p in batch.column("phrase").to_pylist()], pa.int32()),
             pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate([*found, np.zeros(0, _U64)]).view(np.int64)))],
            names=["phrase", "width", "anchors"])


def _asked_in(asked: np.ndarray, widths: list[int]):
    """Task that turns pages into (chunk_id, anchor) rows of the asked anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch.column("full").to_pylist()):
                mine = anchors(text or "", widths)
                at = np.minimum(np.searchsorted(asked, mine), len(asked) - 1)
                mine = mine[asked[at] == mine]
                rows.append(np.full(len(mine), i))
                keys.append(mine)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys).view(np.int64))], names=["chunk_id", "anchor"])
    return run


def locate_passages(passages: DataFrame, pages: DataFrame, qid: str = "query_id", qtext: str = "text", cid: str = "chunk_id", ctext: str = "text") -> DataFrame:
    """(query_id, chunk_id, start, len, strategy) of every pair in which an attempt hits.

    Places count in the normalised page, from 0; the first attempt that hits wins, as in
    ``text.locate_passage``. Passages without a letter or digit are located nowhere, and a
    phrase that cleaning leaves empty is no attempt. Ids should be unique; rows without id are left out.
    """
    target = F.substring(T.normalize_match(F.col(qtext)), 1, T.PASSAGE_CHARS)
    mine = computed(passages.where(F.col(qid).isNotNull()).select(F.col(qid).alias("query_id"), F.col(qtext)), "target", target).where("target <> ''")
    attempts = checkpoint(mine.select("query_id", F.inline(T.passage_attempts(F.col("target")))), "attempts")
    full = pages.where(F.col(cid).isNotNull()).select(F.col(cid).alias("chunk_id"), F.col(ctext).alias("__x"))
    asked = checkpoint(attempts.select("phrase").distinct().mapInArrow(_phrase_anchors, "phrase string, width int, anchors array<bigint>"), "anchors")
    total = asked.agg(F.sum(F.size("anchors"))).first()[0] or 0
    blocks = -(-total // BLOCK_ANCHORS)
    block = F.pmod(F.xxhash64("phrase"), F.lit(max(1, blocks)))
    id_type = full.schema["chunk_id"].dataType.simpleString()
    met = None
    for number in range(blocks):
        part = asked.where(block == number)
        keys = np.unique(part.select(F.explode("anchors").alias("a")).distinct().toArrow()["a"].to_numpy().view(_U64))  # about BLOCK_ANCHORS at most
        widths = [r.width for r in part.where("width > 0").select("width").distinct().collect()]  # 15 at most
        normal = full.select("chunk_id", T.normalize_match(F.col("__x")).alias("full"))
        hits = checkpoint(normal.mapInArrow(_asked_in(keys, sorted(widths)), f"chunk_id {id_type}, anchor bigint"), "hits")
        more = _met(hits, part)
        met = more if met is None else met.unionByName(more)
    if met is None:  # no passage has a phrase
        return full.limit(0).join(attempts.limit(0), F.lit(True)).select("query_id", "chunk_id", F.lit(0).alias("start"), "n", "strategy").withColumnRenamed("n", "len")
    met = checkpoint(met, "met")
    held = computed(full.join(met.select("chunk_id").distinct(), "chunk_id", "left_semi"), "full", T.normalize_match(F.col("__x"))).drop("__x")
    found = computed(held.join(met, "chunk_id"), "at", F.instr("full", F.col("phrase"))).where("at > 0").select("chunk_id", "phrase", "at", F.length("full").alias("size"))
    places = found.join(attempts, "phrase").select("query_id", "chunk_id", F.struct(
        "step", (F.col("at") - 1).alias("start"), F.coalesce("n", F.least(F.lit(100), F.col("size") - F.col("at") + 1)).alias("len"), "strategy").alias("place"))
    return places.groupBy("query_id", "chunk_id").agg(F.min("place").alias("place")).select("query_id", "chunk_id", "place.start", "place.len", "place.strategy")


def _met(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(chunk_id, phrase) whose page has the rarest anchor of the phrase; phrases with an anchor that no page has are nowhere.

    Both sides are plain tables, so Spark splits the pages of a hot anchor over several tasks.
    """
    spread = hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("pages"))
    placed = asked.select("phrase", F.size("anchors").alias("n"), F.explode("anchors").alias("anchor")).join(spread, "anchor")
    rare = placed.groupBy("phrase", "n").agg(F.min(F.struct("pages", "anchor"))["anchor"].alias("anchor"), F.count(F.lit(1)).alias("known")).where("known = n")
    return hits.join(checkpoint(rare.select("phrase", "anchor"), "rarest"), "anchor").select("chunk_id", "phrase")
