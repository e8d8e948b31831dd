"""Search over whole query tables: vectors, keywords, fused lists, neighbours.

Ranked results are rows (query_id, chunk_id, score column, rank from 1). Similarities are
rounded to 9 and text scores to 6 decimals before ranking, so equal items tie whatever the
order of summation, and ties go to the smaller id.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import scoring, text as T
from lexloom.operators.ordered import top_k
from lexloom.operators.rows import computed
from lexloom.operators.setjoin import similar_sets
from lexloom.session import checkpoint, fits, small

# a query matrix up to this many bytes is shipped to every executor; beyond it the search is blocked
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 4096
MAX_LISTED_CELLS = 1000  # probed cells named in the scan's filter
MAX_SCAN_QUERIES = 4096  # up to so many queries are held against the trigrams of every chunk inside its task, more by a set join
MAX_SCAN_TRIGRAMS = 1 << 22  # and up to so many trigrams of these queries together
_CELLS = 1 << 22  # places of a matrix of trigrams inside a task
_SLICE = 1024  # queries
_ROWS = 2048  # and vectors that a task compares at once
_FIRST = 64  # vectors that fill the lists
_MATRIX_BYTES = 32 << 20  # of the queries of a task of a blocked search
_TASK_PRODUCTS = 1 << 40  # and the numbers that it multiplies
_PAIRS = 1 << 20  # numbers of vectors of single pairs at once
_KEY = 1 << 33  # over 2 minus a similarity, in steps of 9 decimals


# ------------------------------------------------------------------ vectors

def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


class _Best:
    """The k best (similarity, id) of each query seen so far: two plain arrays, empty places are -inf."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.sims, self.seen = k, None, np.full((n, k), -np.inf), 0

    def add(self, first: int, sims: np.ndarray, ids: np.ndarray) -> None:
        """The similarities of all ``ids`` (rows) to the queries from ``first`` on (columns)."""
        n, mine = len(ids), self.sims[first:first + sims.shape[1]]
        floor = mine[:, -1]
        if n > self.k:
            floor = np.maximum(floor, np.partition(sims, n - self.k, axis=0)[n - self.k])
        near = (sims >= floor) & (sims > -np.inf)
        if np.count_nonzero(near) > 2 * self.k * len(mine):  # of equal ones, the k smallest ids will do
            order = np.argsort(ids, kind="stable")
            sims, ids, near = sims[order], ids[order], near[order]
            near &= (sims > floor) | (np.cumsum(near & (sims == floor), axis=0, dtype=np.int32) <= self.k)
        row, col = np.nonzero(near)
        self.put(first + col, sims[row, col], ids[row])

    def put(self, at: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """Single similarities of ids to the queries numbered ``at``."""
        if self.ids is None:
            self.ids = np.zeros(self.sims.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids, ids))
        last = self.sims[at, -1]
        new = (sims > last) | (sims == last) & (ids < self.ids[at, -1])
        at, sims, ids = at[new], sims[new], ids[new]
        if not len(at):
            return
        first = at.min()
        some = np.bincount(at - first) > 0
        asked, at = np.flatnonzero(some) + first, np.cumsum(some)[at - first] - 1
        mine = self.sims[asked]
        held = mine > -np.inf
        at = np.concatenate([np.nonzero(held)[0], at])
        s, i = np.concatenate([mine[held], sims]), np.concatenate([self.ids[asked][held], ids])
        if np.abs(s).max() < 2:
            order = np.argsort(i)
            order = order[np.argsort(at[order] * _KEY + np.rint((2 - s[order]) * 1e9).astype(np.int64), kind="stable")]
        else:  # squares of vectors beyond what a double holds
            order = np.lexsort((i, -s, at))
        at, s, i = at[order], s[order], i[order]
        place = np.arange(len(at)) - (np.cumsum(n := np.bincount(at)) - n)[at]
        top = place < self.k
        at = asked[at[top]]
        self.sims[at, place[top]], self.ids[at, place[top]] = s[top], i[top]

    def rows(self, query_ids: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The rows of so many queries at a time."""
        for a in range(0, len(self.sims) if self.ids is not None else 0, _SLICE):
            sims = self.sims[a:a + _SLICE]
            at, place = np.nonzero(sims > -np.inf)
            ids = self.ids[a:a + _SLICE][at, place]
            yield pa.RecordBatch.from_arrays([
                pa.array(query_ids[a:a + _SLICE], schema.field(0).type).take(pa.array(at)),
                pa.array(ids if ids.dtype.kind == "i" else ids.tolist(), schema.field(1).type), pa.array(sims[at, place])], schema=schema)


def _too_long(units: np.ndarray) -> bool:
    """True where a vector's squares were too small for a double, so that its unit is none."""
    return bool(((units * units).sum(axis=1) > 1.5).any())


def _score(best: _Best, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, floor: float | None, allowed=None) -> None:
    """Holds all vectors against all queries, given as units, and keeps the best.

    Products in single precision say which pairs may get into a list, by a margin over their largest
    error; only those pairs are worked out in doubles. Parts begin small, so that lists fill early.
    """
    slack = (queries.shape[1] + 8) * 2.0 ** -23  # twice the bound of the error, and the rounding to 9 decimals
    odd = [_too_long(queries[b:b + _SLICE]) for b in range(0, len(queries), _SLICE)]
    a = 0
    while a < len(vectors):
        part = slice(a, a + min(_ROWS, max(best.seen, _FIRST, 4 * best.k)))
        units, mine, names = _units(vectors[part]), None if allowed is None else allowed(part), ids[part]
        a += len(units)
        best.seen += len(units)
        real = ~np.isnan(units).any(axis=1)  # vectors of length zero have no similarity
        if not real.all():
            units, names, mine = units[real], names[real], None if mine is None else mine[real]
        if not len(units):
            continue
        low, whole = units.astype(np.float32), _too_long(units)
        for n, b in enumerate(range(0, len(queries), _SLICE)):
            asked, ask = queries[b:b + _SLICE], None if mine is None else mine[:, b:b + _SLICE]
            least = best.sims[b:b + _SLICE, -1]
            if floor is not None:
                least = np.maximum(least, floor)
            if whole or odd[n] or np.isneginf(least).all():
                _score_all(best, b, asked, units, names, floor, ask)
                continue
            close, bar = asked.astype(np.float32) @ low.T, np.maximum(least - slack, -4).astype(np.float32)
            if ask is not None:
                close[~ask.T] = -np.inf
            at = np.flatnonzero(close.max(axis=1) >= bar)
            near = close[at] >= bar[at, None]
            if np.count_nonzero(near) > close.size // 8:
                _score_all(best, b, asked, units, names, floor, ask)
                continue
            row, col = np.divmod(np.flatnonzero(near), len(units))
            row = at[row]
            step = max(1, _PAIRS // queries.shape[1])
            for c in range(0, len(row), step):
                r, v = row[c:c + step], col[c:c + step]
                sims = np.round(np.einsum("ij,ij->i", asked[r], units[v]), 9)
                good = sims >= least[r] if floor is None else (sims >= least[r]) & (sims > floor)
                if ask is not None:
                    good &= ask[v, r]
                best.put(b + r[good], sims[good], names[v[good]])


def _score_all(best: _Best, first: int, queries: np.ndarray, units: np.ndarray, ids: np.ndarray, floor: float | None, allowed) -> None:
    """All pairs in doubles: for lists that are still empty, and where most pairs may get into one."""
    sims = np.round(units @ queries.T, 9)
    out = np.isnan(sims)
    if floor is not None:
        out |= ~(sims > floor)
    if allowed is not None:
        out |= ~allowed
    sims[out] = -np.inf
    best.add(first, sims, ids)


def _result_schema(queries: DataFrame, corpus: DataFrame, cols: dict) -> str:
    qt, ct = queries.schema[cols["qid"]].dataType.simpleString(), corpus.schema[cols["cid"]].dataType.simpleString()
    return f"query_id {qt}, chunk_id {ct}, similarity double"


def _arrow_schema(queries: DataFrame, corpus: DataFrame, cols: dict) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.schema([("query_id", to_arrow_type(queries.schema[cols["qid"]].dataType)),
                      ("chunk_id", to_arrow_type(corpus.schema[cols["cid"]].dataType)), ("similarity", pa.float64())])


def semantic_topk(queries: DataFrame, corpus: DataFrame, k: int, min_similarity: float | None = None, qid: str = "query_id",
                  qvec: str = "embedding", cid: str = "chunk_id", cvec: str = "embedding", cell: str | None = None,
                  probes: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top k by cosine for every query, above ``min_similarity`` (strict) when given.

    A query table whose matrix has a proven small size goes to every executor: each task
    scans its part of the corpus once as matrix products and hands on k rows per query, so
    the corpus is never shuffled and a run of equal vectors adds nothing to the shuffle. A
    larger query table is cut into blocks that meet corpus blocks in bounded groups.
    With ``cell`` and ``probes`` (query_id, cell) only rows of a query's cells count.
    Queries and chunks of different vector lengths have no similarity: every length found
    among the queries is searched by itself.
    """
    cols = dict(qid=qid, cid=cid)
    corpus = corpus.where(F.col(cvec).isNotNull()).select(cid, cvec, *([cell] if cell else []))
    queries = queries.where(F.col(qvec).isNotNull()).select(qid, qvec)
    schema, arrow = _result_schema(queries, corpus, cols), _arrow_schema(queries, corpus, cols)
    found = queries.sparkSession.createDataFrame([], schema)
    # one number per embedding model in use
    for dim in sorted(r[0] for r in queries.select(F.size(qvec)).distinct().collect() if r[0] > 0):
        mine, others = queries.where(F.size(qvec) == dim), corpus.where(F.size(cvec) == dim)
        asked = None if probes is None else probes.join(mine.select(F.col(qid).alias("query_id")), "query_id", "left_semi")
        limit = max(1, broadcast_bytes // (dim * 8))
        if fits(mine, limit):
            part = _scan_broadcast(mine, others, cols, qvec, cvec, dim, k, min_similarity, cell, asked, schema, arrow)
        elif cell is None:
            part = _scan_blocks(mine, others, cols, qvec, cvec, dim, k, min_similarity, schema, arrow)
        else:
            part = _scan_cells(mine, others, cols, qvec, cvec, dim, k, min_similarity, cell, asked, schema, arrow)
        found = found.unionByName(part)
    return top_k(found, ["query_id"], [F.col("similarity").desc(), F.col("chunk_id")], k)


def _scan_broadcast(queries, corpus, cols, qvec, cvec, dim, k, floor, cell, probes, schema, arrow):
    got = queries.orderBy(cols["qid"]).toArrow()
    query_ids, matrix = got[cols["qid"]].to_pylist(), _units(_matrix(got[qvec], dim))
    allowed = None
    if cell:
        # the queries of each probed cell: as many numbers as the query table has probes
        place = {q: i for i, q in enumerate(query_ids)}
        pairs = probes.toArrow()
        allowed = {}
        for q, c in zip(pairs["query_id"].to_pylist(), pairs[cell].to_pylist()):
            allowed.setdefault(c, []).append(place[q])
        if len(allowed) <= MAX_LISTED_CELLS:  # cells nobody probes are not read where the corpus is stored by cell
            corpus = corpus.where(F.col(cell).isin(*sorted(allowed)))
    shipped = corpus.sparkSession.sparkContext.broadcast((query_ids, matrix, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m, mask = shipped.value
        best = _Best(len(ids), k)
        for batch in batches:
            if batch.num_rows:
                rows = None if mask is None else partial(_asked_in, mask, batch[cell].to_numpy(), len(ids))
                _score(best, m, _matrix(batch[cvec], dim), _ids(batch[cols["cid"]]), floor, rows)
        yield from best.rows(ids, arrow)

    return corpus.mapInArrow(run, schema)


def _asked_in(probes: dict[int, list[int]], whole: np.ndarray, n: int, rows: slice) -> np.ndarray:
    """Which queries look at each of the rows."""
    cells = whole[rows]
    out = np.zeros((len(cells), n), dtype=bool)
    for c in np.unique(cells).tolist():
        if c in probes:
            out[np.ix_(cells == c, probes[c])] = True
    return out


def _block_scorer(cols, qvec, cvec, dim, k, floor, schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        best = _Best(left.num_rows, k)
        _score(best, _units(_matrix(left[qvec], dim)), _matrix(right[cvec], dim), _ids(right[cols["cid"]]), floor)
        return pa.Table.from_batches(best.rows(left[cols["qid"]].to_pylist(), schema), schema)
    return run


def _grid(n_queries: int, n_corpus: int, dim: int, slots: int) -> tuple[int, int]:
    """Parts of the queries and of the corpus, each pair of which is a task.

    Queries are cut finer: a part more copies the corpus once more, a part of the corpus more also
    adds k rows per query to the result.
    """
    tasks = max(3 * slots, -(-n_queries * n_corpus * dim // _TASK_PRODUCTS))
    n_q = max(-(-n_queries * dim * 8 // _MATRIX_BYTES), math.ceil(math.sqrt(6 * tasks)))
    n_q = min(n_q, n_queries)
    return n_q, max(1, min(-(-tasks // n_q), n_corpus))


def _scan_blocks(queries, corpus, cols, qvec, cvec, dim, k, floor, schema, arrow):
    """Every part of the queries meets every part of the corpus in a task of its own.

    The task holds the matrix and the lists of its queries and reads the corpus batch by batch.
    """
    n_q, n_c = _grid(queries.count(), corpus.count(), dim, corpus.sparkSession.sparkContext.defaultParallelism)
    id_types = queries.schema[cols["qid"]].dataType, corpus.schema[cols["cid"]].dataType

    def part(df, key, vec, n, others):
        return df.withColumn("__part", F.pmod(F.xxhash64(key, vec), F.lit(n)).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    asked = part(queries, cols["qid"], qvec, n_q, n_c).select(
        (F.col("__part") * n_c + F.col("__other")).alias("__task"), F.lit(False).alias("__late"),
        F.col(cols["qid"]).alias("__query"), F.lit(None).cast(id_types[1]).alias("__id"), F.col(qvec).alias("__vec"))
    read = part(corpus, cols["cid"], cvec, n_c, n_q).select(
        (F.col("__other") * n_c + F.col("__part")).alias("__task"), F.lit(True).alias("__late"),
        F.lit(None).cast(id_types[0]).alias("__query"), F.col(cols["cid"]).alias("__id"), F.col(cvec).alias("__vec"))
    tasks = asked.unionByName(read).repartitionById(n_q * n_c, "__task").sortWithinPartitions("__late").drop("__task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, best = [], None
        for batch in batches:
            n = batch.num_rows - (pc.sum(batch["__late"]).as_py() or 0)
            if n:
                mine.append(batch.slice(0, n))
            if n == batch.num_rows or best is None and not mine:
                continue
            if best is None:
                held = pa.Table.from_batches(mine)
                ids, m, best = held["__query"].to_pylist(), _units(_matrix(held["__vec"], dim)), _Best(held.num_rows, k)
                mine, held = [], None
            others = batch.slice(n)
            _score(best, m, _matrix(others["__vec"], dim), _ids(others["__id"]), floor)
        if best is not None:
            yield from best.rows(ids, arrow)

    return tasks.mapInArrow(run, schema)


def _scan_cells(queries, corpus, cols, qvec, cvec, dim, k, floor, cell, probes, schema, arrow):
    """Queries meet the corpus rows of their cells; both sides of a cell are cut into blocks."""
    sizes = corpus.groupBy(cell).agg((F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("__nc"))
    asks = probes.withColumnRenamed("query_id", cols["qid"]).join(queries, cols["qid"])
    loads = asks.groupBy(cell).agg((F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("__nq"))
    grid = sizes.join(loads, cell)
    left = asks.join(grid, cell).withColumn("__q", F.pmod(F.xxhash64(cols["qid"]), F.col("__nq")).cast("int")) \
        .withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__nc") - 1)))
    # both sides of a cogroup need columns of their own
    grid = grid.select(F.col(cell).alias("__cell"), F.col("__nc").alias("__mc"), F.col("__nq").alias("__mq"))
    right = corpus.select(F.col(cols["cid"]).alias("__id"), F.col(cvec).alias("__vec"), F.col(cell).alias("__cell")).join(grid, "__cell") \
        .withColumn("__c", F.pmod(F.xxhash64("__id"), F.col("__mc")).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__mq") - 1))) \
        .withColumnsRenamed({"__cell": cell, "__id": cols["cid"], "__vec": cvec})
    scorer = _block_scorer(cols, qvec, cvec, dim, k, floor, arrow)
    return left.groupBy(cell, "__q", "__c").cogroup(right.groupBy(cell, "__q", "__c")).applyInArrow(scorer, schema)


def build_cells(corpus: DataFrame, n_cells: int, cid: str = "chunk_id", cvec: str = "embedding", seed: int = 7, rounds: int = 10):
    """(model, corpus with column ``cell``): vectors grouped around k-means centres.

    This takes the place of an inverted-file vector index: write the result partitioned by
    ``cell`` and a search reads only the cells it probes.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from lexloom.functions.vectors import unit
    data = corpus.where(F.col(cvec).isNotNull()).withColumn("__v", array_to_vector(unit(F.col(cvec))))
    model = KMeans(k=n_cells, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cell").fit(data)
    return model, model.transform(data).drop("__v")


def probe_cells(model, queries: DataFrame, n_probe: int, qid: str = "query_id", qvec: str = "embedding") -> DataFrame:
    """(query_id, cell) of the ``n_probe`` centres nearest to each query."""
    centres = np.stack(model.clusterCenters())
    source = queries.where(F.col(qvec).isNotNull()).select(qid, qvec)
    id_type = source.schema[qid].dataType.simpleString()
    dim = centres.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = _units(_matrix(batch[qvec], dim)) @ _units(centres).T
            near = np.argsort(-sims, axis=1, kind="stable")[:, :n_probe]
            ids = batch[qid].take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.ravel().astype("int32"))], names=["query_id", "cell"])

    return source.mapInArrow(run, f"query_id {id_type}, cell int")


def nearest_centres(vectors: DataFrame, centres: DataFrame, n: int, vid: str, vvec: str = "embedding", out: str = "cell") -> DataFrame:
    """(vid, cell) of the ``n`` centres nearest by cosine to each vector; ties go to the smaller centre id.

    centres: cell (int), embedding. Their number grows with the root of a corpus; they go to
    every task, so their matrix must stay below BROADCAST_BYTES.
    """
    held = centres.select("cell", "embedding").orderBy("cell")
    dim = held.select(F.size("embedding")).first()
    limit = BROADCAST_BYTES // (8 * max(1, dim[0] if dim else 1))
    if not fits(held, limit):
        raise ValueError(f"more than {limit} centres: group the centres into cells of their own first")
    got = held.toArrow()
    cells, matrix = got["cell"].to_numpy(), _units(_matrix(got["embedding"], dim[0])) if dim else np.zeros((0, 1))
    shipped = vectors.sparkSession.sparkContext.broadcast((cells, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, units = shipped.value
        for batch in batches:
            if not batch.num_rows or not len(numbers):
                continue
            sims = np.round(np.nan_to_num(_units(_matrix(batch[vvec], units.shape[1])), nan=-1.0) @ units.T, 9)
            near = np.argsort(-sims, axis=1, kind="stable")[:, :n]
            ids = batch[vid].take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers[near.ravel()].astype(np.int32))], names=[vid, out])

    kind = vectors.schema[vid].dataType.simpleString()
    return vectors.where(F.col(vvec).isNotNull()).select(vid, vvec).mapInArrow(run, f"{vid} {kind}, {out} int")


def cell_topk(queries: DataFrame, corpus: DataFrame, centres: DataFrame, k: int, n_probe: int) -> DataFrame:
    """Approximate top k over given centres: every chunk belongs to its nearest centre, a query
    looks into the cells of its ``n_probe`` nearest ones."""
    members = nearest_centres(corpus, centres, 1, "chunk_id")
    cells = checkpoint(corpus.join(members, "chunk_id").repartition("cell").sortWithinPartitions("cell"), "cells")
    return semantic_topk(queries, cells, k, cell="cell", probes=nearest_centres(queries, centres, n_probe, "query_id"))


def ann_topk(queries: DataFrame, cells: DataFrame, model, k: int, n_probe: int, **kw) -> DataFrame:
    """Approximate top k: only the cells nearest to a query are scored."""
    probes = probe_cells(model, queries, n_probe, kw.get("qid", "query_id"), kw.get("qvec", "embedding"))
    return semantic_topk(queries, cells, k, cell="cell", probes=probes, **kw)


# ------------------------------------------------------------------ keywords

def postings(corpus: DataFrame, cid: str = "chunk_id", text: str = "text") -> DataFrame:
    """Inverted index rows (term, chunk_id, tf, doc_len)."""
    words = computed(corpus.select(F.col(cid).alias("chunk_id"), F.col(text).alias("__x")), "__w", T.tokens(F.col("__x")))
    return (
        words.select("chunk_id", F.size("__w").cast("bigint").alias("doc_len"), F.explode("__w").alias("term"))
        .groupBy("term", "chunk_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    )


def write_postings(corpus: DataFrame, path: str, buckets: int = 256, salts: int = 8, **kw) -> None:
    """The inverted index as Parquet by term bucket; a frequent term is spread over ``salts`` tasks."""
    rows = postings(corpus, **kw).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(salts))
    rows.repartition("bucket", salt).sortWithinPartitions("term", "chunk_id").write.partitionBy("bucket").parquet(path)


def query_terms(queries: DataFrame, qid: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, n_terms): distinct search terms of each query."""
    t = computed(queries.select(F.col(qid).alias("query_id"), F.col(text).alias("__x")), "__t", T.search_terms(F.col("__x")))
    return t.select("query_id", F.size("__t").cast("bigint").alias("n_terms"), F.explode("__t").alias("term"))


def keyword_scores(terms: DataFrame, corpus: DataFrame, match: str = "or", cid: str = "chunk_id", text: str = "text",
                   k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of every (query_id, chunk_id) that match, with n_hit terms found.

    ``match="and"`` keeps chunks holding every term of the query. Tokens that no query asks
    for are dropped right after the split, before any shuffle, and term counts and partial
    scores are combined before they move. A term in a third of all chunks therefore costs
    one row per chunk, spread by chunk.
    """
    size = corpus.select(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(F.col(text), F.lit(T.WORD))).alias("avg_len")).alias("s"))
    total = size.scalar()
    n, avg_len = total["n"], total["avg_len"]
    asked = small(terms.select("term").distinct())
    words = computed(corpus.select(F.col(cid).alias("chunk_id"), F.col(text).alias("__x")), "__w", T.tokens(F.col("__x")))
    hits = (
        words.select("chunk_id", F.size("__w").alias("doc_len"), F.explode("__w").alias("term"))
        .join(asked, "term", "left_semi")
        .groupBy("chunk_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    # used twice: the matching postings are kept, so the corpus is split into words once
    hits = checkpoint(hits, "postings")
    spread = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(spread, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / avg_len))
    scored = (
        hits.join(small(weighted), "term").groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("n_hit"), F.max("n_terms").alias("n_terms"))
    )
    if match == "and":
        scored = scored.where(F.col("n_hit") == F.col("n_terms"))
    return scored.drop("n_terms")


_TOKENS = 1 << 18  # words coded at once inside a task, or those of one text
_PAIRS = 1 << 19  # (query, chunk, term) triples worked on at once inside a task
_TERM_BYTES = 64  # of a (query, term) row in a task, beside the term itself


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about _TOKENS words."""
    for batch in batches:
        ends = batch["__w"].offsets.to_numpy().astype(np.int64)
        part = (ends[:-1] - ends[0]) // _TOKENS
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if batch.num_rows else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def _count_terms(asked: pa.Array):
    """Task that turns token lists into counts of the asked terms, given by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            lists = batch["__w"]
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            code = pc.index_in(lists.flatten(), value_set=asked)
            known = pc.is_valid(code).to_numpy(zero_copy_only=False)
            both, tf = np.unique(row[known] * max(1, len(asked)) + code.drop_null().to_numpy(), return_counts=True)
            row, code = np.divmod(both, max(1, len(asked)))
            ends = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["chunk_id"], pa.array(size.astype(np.int64), mask=lists.is_null().to_numpy(zero_copy_only=False)),
                 pa.ListArray.from_arrays(ends, pa.array(code.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                names=["chunk_id", "doc_len", "terms", "tfs"])
    return run


def _score_terms(shipped, k: int, match: str, k1: float, b: float, schema: pa.Schema):
    """Task that scores its chunks for all queries and hands on k rows per query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, needed, starts, asking, idf, avg_len = shipped.value
        best_q, best_s, best_n, best_id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None
        floor = np.full(len(query_ids), -np.inf)
        for whole in batches:
            entries = np.diff(whole["terms"].offsets.to_numpy())
            term, tf = whole["terms"].flatten().to_numpy(), whole["tfs"].flatten().to_numpy().astype(np.float64)
            row = np.repeat(np.arange(len(entries)), entries)
            length = whole["doc_len"].to_numpy(zero_copy_only=False).astype(np.float64)[row]
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
            ids = _ids(whole["chunk_id"])
            best_id = ids[:0] if best_id is None else best_id
            fan = starts[term + 1] - starts[term]
            cut = np.searchsorted(np.cumsum(fan), np.arange(_PAIRS, max(1, fan.sum()) + _PAIRS, _PAIRS), side="right")
            edge = np.r_[0, np.cumsum(entries)]
            at = 0
            for stop in np.unique(edge[np.minimum(np.searchsorted(edge, cut, side="left"), len(edge) - 1)]):  # whole chunks only
                part, at = slice(at, int(stop)), int(stop)
                n = fan[part]
                ends = np.cumsum(n)
                query = asking[np.repeat(starts[term[part]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
                pair, place, hits = np.unique(np.repeat(row[part], n) * len(query_ids) + query, return_inverse=True, return_counts=True)
                chunk, query = np.divmod(pair, max(1, len(query_ids)))
                score = np.round(np.bincount(place, np.repeat(weight[part], n), len(pair)), 6)
                keep = score >= floor[query]
                if match == "and":
                    keep &= hits == needed[query]
                best_q, best_s, best_n = np.r_[best_q, query[keep]], np.r_[best_s, score[keep]], np.r_[best_n, hits[keep]]
                best_id = np.concatenate([best_id, ids[chunk[keep]]])
                order = np.lexsort((best_id, -best_s, best_q))
                best_q, best_s, best_n, best_id = best_q[order], best_s[order], best_n[order], best_id[order]
                first = np.searchsorted(best_q, best_q, side="left")
                top = np.arange(len(best_q)) - first < k
                best_q, best_s, best_n, best_id = best_q[top], best_s[top], best_n[top], best_id[top]
                last = np.flatnonzero(np.arange(len(best_q)) - np.searchsorted(best_q, best_q, side="left") == k - 1)
                floor[best_q[last]] = best_s[last]
        if best_id is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([query_ids[q] for q in best_q.tolist()], schema.field(0).type), pa.array(best_id.tolist(), schema.field(1).type), pa.array(best_s), pa.array(best_n)], schema=schema)
    return run


def keyword_topk(terms: DataFrame, corpus: DataFrame, k: int, match: str = "or", cid: str = "chunk_id", text: str = "text",
                 k1: float = 1.2, b: float = 0.75, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The best k of ``keyword_scores`` per query: (query_id, chunk_id, score, n_hit, rank).

    The corpus is split into words once. All terms of a chunk are in one row, so each task
    scores its chunks by itself and only k rows per query and task move, however common a
    word is. The terms sent to tasks are bounded: a larger query table is cut into blocks of
    queries, each a pass of its own.
    """
    schema = f"query_id {terms.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema[cid].dataType.simpleString()}, score double, n_hit long"
    arrow = _arrow_schema(terms, corpus, dict(qid="query_id", cid=cid))
    arrow = pa.schema([arrow.field(0), arrow.field(1), ("score", pa.float64()), ("n_hit", pa.int64())])
    terms = checkpoint(terms.select("query_id", "term", "n_terms"), "terms")
    total = terms.agg(F.sum(F.octet_length("term") + _TERM_BYTES)).first()[0] or 0
    blocks = -(-total // block_bytes)
    words = computed(corpus.select(F.col(cid).alias("chunk_id"), F.col(text).alias("__x")), "__w", T.tokens(F.col("__x"))).select("chunk_id", "__w")
    found = terms.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id", "term").toArrow()  # at most about block_bytes
        if not mine.num_rows:
            continue
        coded = mine["term"].combine_chunks().dictionary_encode()
        id_type = corpus.schema[cid].dataType.simpleString()
        counted = checkpoint(words.mapInArrow(_count_terms(coded.dictionary), f"chunk_id {id_type}, doc_len long, terms array<int>, tfs array<int>"), "term-counts")
        size = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len")).first()
        spread = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()  # one row per asked term
        df = np.zeros(len(coded.dictionary))
        df[spread["t"].to_numpy()] = spread["df"].to_numpy()
        idf = np.log(1 + (size["n"] - df + 0.5) / (df + 0.5))
        queries = mine["query_id"].combine_chunks().dictionary_encode()
        code, query = coded.indices.to_numpy(), queries.indices.to_numpy().astype(np.int64)
        needed = np.zeros(len(queries.dictionary), np.int64)
        needed[query] = mine["n_terms"].to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        shipped = terms.sparkSession.sparkContext.broadcast((queries.dictionary.to_pylist(), needed, starts, query[order], idf, size["avg_len"] or 1.0))
        hit = counted.where(F.size("terms") > 0)
        found = found.unionByName(hit.mapInArrow(_score_terms(shipped, k, match, k1, b, arrow), schema))
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def keyword_matches(terms: DataFrame, corpus: DataFrame, cid: str = "chunk_id", text: str = "text") -> DataFrame:
    """Every (query_id, chunk_id) where the chunk holds all terms of the query, without scores or a bound.

    A query meets only the chunks that hold its rarest term; the others are looked up in the row.
    """
    terms = checkpoint(terms.select("query_id", "term"), "terms")
    words = computed(corpus.select(F.col(cid).alias("chunk_id"), F.col(text).alias("__x")), "__w", F.array_distinct(T.tokens(F.col("__x")))).select("chunk_id", "__w")
    asked = small(terms.select("term").distinct())
    postings = checkpoint(words.select("chunk_id", F.explode("__w").alias("term")).join(asked, "term", "left_semi"), "postings")
    spread = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = terms.join(spread, "term", "left").groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("term"), F.collect_set("term").alias("terms"))
    # both sides are plain tables: Spark splits a hot term over several tasks
    rare = checkpoint(rare, "rarest")
    met = postings.join(rare, "term").select("query_id", "chunk_id", "terms")
    held = postings.groupBy("chunk_id").agg(F.collect_set("term").alias("held"))  # never more than the words of one text
    return met.join(held, "chunk_id").where(matches_all(F.col("held"), F.col("terms"))).select("query_id", "chunk_id").distinct()


def matches_all(tokens: Column, terms: Column) -> Column:
    """Row form of the AND match for a term array."""
    return F.forall(terms, lambda t: F.array_contains(tokens, t))


def matches_any(tokens: Column, terms: Column) -> Column:
    return F.arrays_overlap(tokens, terms)


def _set_slices(sets: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Query sets cut into (first query, sizes, sorted elements, matrix of elements by queries) of bounded size."""
    slices, first = [], 0
    while first < len(sets):
        last, n = first + 1, len(sets[first])
        while last < len(sets) and (n + len(sets[last])) * (last + 1 - first) <= _CELLS:
            n, last = n + len(sets[last]), last + 1
        sizes = np.array([len(x) for x in sets[first:last]])
        elements, code = np.unique(np.concatenate(sets[first:last]), return_inverse=True)
        matrix = np.zeros((len(elements), last - first), np.float32)
        matrix[code, np.repeat(np.arange(last - first), sizes)] = 1
        slices.append((first, sizes, elements, matrix))
        first = last
    return slices


def _shared_with(slices: list, batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row of the batch, shared, score) of the similar pairs, part by part."""
    lists = batch["elements"]
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    values, edge = lists.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]
    for first, asked, elements, matrix in slices:
        able = (sizes >= threshold * asked.min()) & (sizes * threshold <= asked.max()) & (sizes > 0)
        at = np.flatnonzero(able)
        step = max(1, _CELLS // max(len(elements), len(asked)))
        place = np.minimum(np.searchsorted(elements, values), len(elements) - 1)
        known = elements[place] == values
        for a in range(0, len(at), step):
            rows = at[a:a + step]
            lo, hi = edge[rows[0]], edge[rows[-1] + 1]
            where = np.repeat(np.arange(rows[0], rows[-1] + 1), sizes[rows[0]:rows[-1] + 1])
            use = known[lo:hi] & able[where]
            held = np.zeros((len(rows), len(elements)), np.float32)
            held[np.searchsorted(rows, where[use]), place[lo:hi][use]] = 1
            shared = held @ matrix
            score = shared.astype(np.float64) / (sizes[rows][:, None] + asked[None, :] - shared)
            row, query = np.nonzero(score >= threshold - 1e-12)
            yield first + query, rows[row], shared[row, query].astype(np.int64), score[row, query]


def _scan_sets(asked: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """``setjoin.similar_sets`` for a bounded left side, which goes to every task."""
    rows = asked.where(F.col("id").isNotNull() & (F.size("elements") > 0)).toArrow()
    lists = rows["elements"].combine_chunks()
    edge = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    shipped = asked.sparkSession.sparkContext.broadcast((rows["id"].combine_chunks(), _set_slices([values[a:b] for a, b in zip(edge[:-1], edge[1:])])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slices = shipped.value
        for batch in batches:
            for query, row, shared, score in _shared_with(slices, batch, threshold):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch["id"].take(pa.array(row)), pa.array(shared), pa.array(score)], names=["left_id", "right_id", "shared", "score"])
    kinds = [d.schema["id"].dataType.simpleString() for d in (asked, held)]
    return held.where(F.col("id").isNotNull()).select("id", "elements").mapInArrow(run, f"left_id {kinds[0]}, right_id {kinds[1]}, shared long, score double")


def trigram_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float = 0.3, qid: str = "query_id", qtext: str = "text",
                 cid: str = "chunk_id", ctext: str = "text") -> DataFrame:
    """Chunks whose trigram set is similar to the query's, best k.

    A bounded query table is sent to the tasks, which count what each chunk shares with all
    queries by matrix products, so only similar pairs leave a task. A larger one is matched by a
    prefix-filtered set join, see setjoin. Both are exact.
    """
    def sets(df, key, text):
        # named, a trigram is 8 bytes
        return computed(df.select(F.col(key).alias("id"), F.col(text).alias("__x")), "elements", F.transform(T.trigrams(F.col("__x")), lambda g: F.xxhash64(g))).drop("__x")
    asked, held = checkpoint(sets(queries, qid, qtext), "asked"), sets(corpus, cid, ctext)
    total = asked.agg(F.count(F.lit(1)), F.sum(F.size("elements"))).first()
    if total[0] <= MAX_SCAN_QUERIES and (total[1] or 0) <= MAX_SCAN_TRIGRAMS:
        sim = _scan_sets(asked, held, threshold)
    else:
        sim = similar_sets(asked, held, threshold)
    sim = sim.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("chunk_id"), F.round("score", 9).alias("score"))
    return top_k(sim, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


# ------------------------------------------------------------------ fusion

def fuse(semantic: DataFrame, keyword: DataFrame, k: int, rrf_k: int = 60, w_semantic: float = 1.0, w_keyword: float = 1.0) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists; a row in one list only scores 0 in the other."""
    s = semantic.select("query_id", "chunk_id", F.col("rank").alias("semantic_rank"))
    t = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    both = s.join(t, ["query_id", "chunk_id"], "full_outer")
    label = F.when(F.col("semantic_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "semantic + keyword") \
        .when(F.col("semantic_rank").isNotNull(), "semantic").otherwise("keyword")
    score = scoring.rrf_term(F.col("semantic_rank"), rrf_k, w_semantic) + scoring.rrf_term(F.col("keyword_rank"), rrf_k, w_keyword)
    out = both.withColumn("rrf_score", F.round(score, 9)).withColumn("search_type", label)
    return top_k(out, ["query_id"], [F.col("rrf_score").desc(), F.col("chunk_id")], k)


def fuse_left(semantic: DataFrame, keyword: DataFrame, k: int, rrf_k: int = 60, w_semantic: float = 0.7, w_keyword: float = 0.3) -> DataFrame:
    """Fusion that keeps semantic hits only; an absent keyword rank counts as 3k + 1."""
    s = semantic.select("query_id", "chunk_id", F.col("rank").alias("semantic_rank"))
    t = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    both = s.join(t, ["query_id", "chunk_id"], "left").withColumn("keyword_rank", F.coalesce("keyword_rank", F.lit(3 * k + 1)))
    score = scoring.rrf_term(F.col("semantic_rank"), rrf_k, w_semantic) + scoring.rrf_term(F.col("keyword_rank"), rrf_k, w_keyword)
    return top_k(both.withColumn("rrf_score", F.round(score, 9)), ["query_id"], [F.col("rrf_score").desc(), F.col("chunk_id")], k)


def hybrid_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, min_similarity: float | None = None, rrf_k: int = 60,
                w_semantic: float = 1.0, w_keyword: float = 1.0, match: str = "and", vectors: DataFrame | None = None) -> DataFrame:
    """Vector and keyword search, twice k each, fused.

    queries: query_id, text, embedding; corpus: chunk_id, text, embedding. Vectors kept in a
    table of their own (chunk_id, embedding) are passed as ``vectors`` and need no join.
    """
    semantic = semantic_topk(queries, corpus if vectors is None else vectors, 2 * k, min_similarity)
    keyword = keyword_topk(query_terms(queries), corpus, 2 * k, match)
    return fuse(semantic, keyword, k, rrf_k, w_semantic, w_keyword)


def with_fallback(results: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of ``fallback`` for the queries that have none in ``results``."""
    missing = fallback.join(results.select("query_id").distinct(), "query_id", "left_anti")
    return results.unionByName(missing, allowMissingColumns=True)


def merge_lists(lists: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of any number of ranked lists (query_id, chunk_id, rank)."""
    rows = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", "chunk_id", "rank"))
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(scoring.rrf_term(F.col("rank"), rrf_k)), 9).alias("rrf_score"), F.count(F.lit(1)).alias("n_lists"))
    return top_k(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("chunk_id")], k)


def expand_neighbours(results: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """Content of each hit widened to the chunks ``window`` before and after it.

    Of several hits in one stretch of 2 * window chunks of a file only the best ranked stays.
    results: query_id, rank, document_id, file_name, chunk_index, content;
    chunks: document_id, chunk_index, content.
    """
    stretch = F.floor(F.col("chunk_index") / (2 * window))
    first = Window.partitionBy("query_id", "file_name", stretch).orderBy("rank")
    kept = results.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")
    wanted = kept.select("query_id", "rank", "document_id", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("chunk_index") - window).cast("bigint"), (F.col("chunk_index") + window).cast("bigint"))).alias("chunk_index"))
    near = (
        wanted.join(chunks.select("document_id", "chunk_index", F.col("content").alias("__c")), ["document_id", "chunk_index"])
        .groupBy("query_id", "rank")
        # at most 2 * window + 1 rows per group
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "__c"))), lambda s: s["__c"]), "\n\n").alias("__near"))
    )
    return kept.join(near, ["query_id", "rank"], "left").withColumn("content", F.coalesce("__near", "content")).drop("__near")


def cached_answers(queries: DataFrame, log: DataFrame, now: Column, threshold: float = 0.95, **kw) -> DataFrame:
    """Nearest earlier query of the log with similarity of at least ``threshold``, not expired.

    log: chunk_id (the earlier query), embedding, expires_at.
    """
    live = log.where(F.col("expires_at") > now)
    return semantic_topk(queries, live, 1, None, **kw).where(F.col("similarity") >= threshold)


def mean_query_vectors(passages: DataFrame, qid: str = "query_id", vector: str = "embedding") -> DataFrame:
    """One vector per query: the element-wise mean of its passages' vectors.

    Elements are averaged one by one, so the aggregation is partial and nothing is collected per query.
    """
    parts = passages.select(qid, F.posexplode(vector).alias("__i", "__x")).groupBy(qid, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    # one row per vector element
    return parts.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(vector))
