"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A document is the set of its distinct runs of five words. Equal sets are one class, so copies
are never compared. Each class gets a SuperMinHash signature: every element deals ranks
0, 1, 2, ... to the places of the signature in an order of its own, and stops as soon as its
ranks are larger than all places hold. Classes that agree in a band of the signature are
candidates. In a bucket every class is first checked against the smallest one only. Where that
leaves several components, members of different ones are compared by sketches inside the
tasks, and only pairs that may still link are checked. Checks compare full sets. Components come from union-find inside tasks and star contraction between them.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lexloom.llm import words
from lexloom.session import checkpoint, settled

SHINGLE = 5
ROWS = 4
MISSED = 2.1e-8  # chance that a pair at the threshold agrees in no band
PERCENT = 85
SKETCH = 1024  # smallest hashes kept of a set; smaller sets are kept whole
DEVIATIONS = 5.5  # a pair at the threshold is dropped by an estimate with a chance of 2e-8
CHUNK = 128  # documents compared with one leader in one task
_U64 = np.uint64


def bands_for(percent: int) -> int:
    """Bands that keep the chance of a miss at the threshold under MISSED: 24 at 85, 34 at 80."""
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS)) if percent < 100 else 1


def min_agree(percent: int) -> float:
    """Share of the places of two signatures that a pair at the threshold agrees in at least."""
    p = percent / 100
    return p - DEVIATIONS * (p * (1 - p) / (ROWS * bands_for(percent))) ** 0.5


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct word runs of every text; fewer words than ``width`` form one run."""
    codes, bounds, vocabulary = words.split(texts, lower=True)
    word_hash = words.hashes(vocabulary)[codes] if len(codes) else np.zeros(0, _U64)
    size = np.diff(bounds)
    start, run = words.rolling(word_hash, bounds, width)
    row = words.row_of(bounds)
    owner = [row[start]] if len(codes) else [np.zeros(0, np.int64)]
    values = [run]
    for n in range(1, width):  # short texts: the whole sequence
        rows = np.flatnonzero(size == n)
        total = np.full(len(rows), n, _U64)
        for k in range(n):
            total = total * _U64(0x9E3779B97F4A7C15) + word_hash[bounds[rows] + k]
        owner.append(rows)
        values.append(words.mix(total))
    owner, values = np.concatenate(owner), np.concatenate(values)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])] if len(owner) else np.zeros(0, bool)
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(size) + 1))


def super_minhash(values: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """Signatures (sets, places): the smallest rank + fraction that any element dealt to each place.

    An element shuffles the places step by step, and the place that step j fixes gets rank j.
    Here all elements of all sets take step j together; a set stops once every place holds
    less than the next rank.
    """
    sets = len(bounds) - 1
    best = np.full((sets, places), np.inf)
    owner, state, picks = words.row_of(bounds), values.copy(), []
    for j in range(places):
        state = words.mix(state + _U64(0x9E3779B97F4A7C15))
        fraction = (state >> _U64(11)).astype(np.float64) / 2.0 ** 53
        pick = j + ((words.mix(state ^ _U64(0xD1B54A32D192ED03)) >> _U64(32)).astype(np.int64) * (places - j) >> 32)
        place = pick.copy()
        for i in range(j - 1, -1, -1):  # an earlier swap moved what was at i to the picked position
            place[place == picks[i]] = i
        np.minimum.at(best.reshape(-1), owner * places + place, fraction + j)
        stay = (best.max(axis=1) >= j + 1)[owner]
        picks.append(pick)
        if not stay.all():
            owner, state, picks = owner[stay], state[stay], [p[stay] for p in picks]
        if not len(owner):
            break
    return best


def _bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of ROWS places."""
    parts = signature.view(_U64).reshape(len(signature), -1, ROWS)
    key = np.arange(1, parts.shape[1] + 1, dtype=_U64)[None, :] * _U64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = words.mix(key + parts[:, :, r])
    return key.view(np.int64)


def _mark(bands: int):
    def mark(batches):
        for batch in words.slices(batches):
            values, bounds = shingle_sets(batch.column("text"))
            signature = super_minhash(values, bounds, ROWS * bands)
            small = words.mix(signature.view(_U64)).astype(np.uint8)  # one byte a place is enough to estimate
            keys = _bands(signature)
            ids = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            top = (values >> _U64(32)).astype("<u4")  # sets are sorted, so the first are the smallest
            sketch = [top[a:min(b, a + SKETCH)].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(ids, pa.binary()), pa.array([r.tobytes() for r in small], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "signature", "bands", "sketch"])
    return mark


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature, bands) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _mark(bands_for(percent)), f"doc_id {kind}, n_shingles long, set_id binary, signature binary, bands array<long>, sketch binary")


def _alike_in_size(n: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _compare(percent: int):
    """Streams (leader, chunk, role, doc_id, text), the leader's text first, into linked pairs."""
    def compare(batches):
        current = leader_set = None
        for batch in words.slices(batches):
            values, bounds = shingle_sets(batch.column("text"))
            a, b = [], []
            leads, docs, roles = batch.column("leader").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("role").to_pylist()
            for i, (leader, doc, role) in enumerate(zip(leads, docs, roles)):
                mine = values[bounds[i]:bounds[i + 1]]
                if role == 0:
                    current, leader_set = leader, mine
                elif leader == current and len(mine) and len(leader_set):
                    at = np.minimum(np.searchsorted(leader_set, mine), len(leader_set) - 1)
                    shared = int((leader_set[at] == mine).sum())
                    if 100 * shared >= percent * (len(mine) + len(leader_set) - shared):
                        a.append(max(doc, leader))
                        b.append(min(doc, leader))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return compare


def verify(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (doc, leader) whose full sets link them, as edges (a, b) with a > b.

    A leader with many partners is sent to several tasks, each with its share of them; texts
    stream past the one set that a task holds.
    """
    pairs = checkpoint(pairs, "pairs")
    load = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    leaders = load.select(F.col("leader").alias("doc_id"), "leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    load = checkpoint(load.where("chunks > 1"), "load")
    members = pairs.join(load, "leader", "left").select(
        F.col("doc").alias("doc_id"), "leader",
        F.pmod(F.xxhash64("doc"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"), F.lit(1).alias("role"))
    wanted = checkpoint(leaders.unionByName(members), "wanted")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = wanted.hint("merge").join(texts, "doc_id")  # both sides grow with the corpus
    dealt = rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "role")
    return dealt.select("leader", "chunk", "role", "doc_id", "text").mapInArrow(_compare(percent), "a long, b long")


def _forest(batches):
    """Union-find over the edges of one task: every node with the smallest node it reaches here."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    found = [(x, find(x)) for x in list(parent)]
    a, b = [x for x, r in found if x != r], [r for x, r in found if x != r]
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of an edge (a, b).

    Tasks shrink their edges to forests; then every node takes its smallest neighbour, twice
    over, and the edges are redrawn between those, until none is left.
    """
    edges = checkpoint(edges.select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up")
        above = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        up = checkpoint(up.join(above, "up").select("node", F.col("upper").alias("up")), "up")
        for end in "ab":
            edges = edges.join(up.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("up", end)
        edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        step = up.select(F.col("node").alias("root"), F.col("up").alias("new"))
        labels = up.select("node", F.col("up").alias("root")) if labels is None else (
            labels.join(step, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        labels = checkpoint(labels, "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


_BLOCK = 1024


class _Held:
    """Members outside the main component of a group, against which the others are compared."""

    def __init__(self, rows: list[dict], percent: int):
        self.percent = percent
        self.c, self.n, self.root = (np.array([r[k] for r in rows], np.int64) for k in ("c", "n", "root"))
        self.signature = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint8).reshape(len(rows), -1)
        parts = [np.frombuffer(r["sketch"], "<u4") for r in rows]
        self.size = np.array([len(p) for p in parts])
        self.owner = np.repeat(np.arange(len(rows)), self.size)
        self.values = np.concatenate(parts)
        self.sorted = (self.owner.astype(np.uint64) << _U64(32)) | self.values
        self.start = np.cumsum(self.size) - self.size
        self.most = np.where(self.n > self.size, self.values[self.start + self.size - 1], 2 ** 32 - 1).astype(np.int64)

    def partners(self, row: dict) -> np.ndarray:
        """Places of the members that may link with the row and are in another component."""
        alike = 100 * np.minimum(self.n, row["n"]) >= self.percent * np.maximum(self.n, row["n"])
        near = np.flatnonzero(alike & (self.root != row["root"]))
        near = near[(self.signature[near] == np.frombuffer(row["signature"], np.uint8)).mean(axis=1) >= min_agree(self.percent)]
        if not len(near):
            return near
        mine = np.frombuffer(row["sketch"], "<u4")
        most = int(mine[-1]) if row["n"] > len(mine) else 2 ** 32 - 1
        # up to the smaller of the two last hashes both sketches are complete: the overlap there estimates the whole, or is it
        limit = np.minimum(self.most[near], most)
        of_mine = np.searchsorted(mine, limit, side="right")
        of_held = np.searchsorted(self.sorted, (near.astype(np.uint64) << _U64(32)) | limit.astype(np.uint64), side="right") - self.start[near]
        picked = np.repeat(np.arange(len(near)), self.size[near])
        values = self.values[np.repeat(self.start[near] - (np.cumsum(self.size[near]) - self.size[near]), self.size[near]) + np.arange(len(picked))]
        at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
        shared = np.bincount(picked[mine[at] == values], minlength=len(near))
        union = np.maximum(of_mine + of_held - shared, 1)
        p = self.percent / 100
        slack = np.where(limit < 2 ** 32 - 1, DEVIATIONS * np.sqrt(p * (1 - p) / union), 0)
        return near[shared >= (p - slack) * union - 1e-9]


def _agreeing(percent: int):
    """Streams members of groups, the few (role 0) before all (role 1), into pairs that may still link."""
    def agreeing(batches):
        rows_held, held, key = [], None, None
        for batch in batches:
            doc, leader = [], []
            for row in batch.to_pylist():
                if row["role"] == 0:
                    if key != (row["leader"], row["block"]):
                        rows_held, key = [], (row["leader"], row["block"])
                    rows_held.append(row)
                    held = None
                elif key == (row["leader"], row["block"]):
                    held = held or _Held(rows_held, percent)
                    for c in held.c[held.partners(row)].tolist():
                        doc.append(max(c, row["c"]))
                        leader.append(min(c, row["c"]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(leader, pa.int64())], names=["doc", "leader"])
    return agreeing


def open_pairs(members: DataFrame, checked: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs that share a leader, are in different components, may still link and were not checked yet.

    ``members``: (leader, c, n, root, signature, sketch). Only members outside the largest
    component of their group are compared with the others, in blocks, so a hot group is
    spread. The comparison stays inside the task: pairs that sizes, signatures or sketches rule out are
    never rows.
    """
    parts = checkpoint(members.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("m")), "parts")
    shape = parts.groupBy("leader").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("all"))
    few, every = F.ceil((F.col("all") - F.col("most.m")) / _BLOCK).cast("long"), F.ceil(F.col("all") / _BLOCK).cast("long")
    shape = checkpoint(shape.where("roots > 1").select("leader", F.col("most.root").alias("main"), few.alias("k"), every.alias("spread")), "shape")
    inside = members.join(shape, "leader")
    own, other = F.pmod(F.xxhash64("c"), F.col("k")), F.pmod(F.xxhash64("c"), F.col("spread"))

    def blocks(count, number):
        return F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), number)).alias("block")
    columns = ["c", "n", "root", "signature", "sketch"]
    left = inside.where("root <> main").select("leader", blocks("spread", lambda i: own * F.col("spread") + i), F.lit(0).alias("role"), *columns)
    right = inside.select("leader", blocks("k", lambda i: i * F.col("spread") + other), F.lit(1).alias("role"), *columns)
    dealt = left.unionByName(right).repartition("leader", "block").sortWithinPartitions("leader", "block", "role")
    pairs = dealt.mapInArrow(_agreeing(percent), "doc long, leader long").distinct()
    return pairs.join(checked, ["doc", "leader"], "left_anti")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Component of every document: (doc_id, n_shingles, component_id, kept, class_id).

    Needs doc_id (a whole number) and text. Documents link if their shingle sets share at
    least ``percent`` per cent of their union; components are those of all links, named by their
    smallest doc_id, which is the document kept. class_id is the smallest doc_id with the same
    set. A null text, or one without words, has an empty set, links with nothing and is kept.
    Rows without doc_id take no part: class and component are null, and they are kept. Rows that repeat a doc_id
    are one document; if their texts differ, it links as each of them. Other columns are left out, an empty table
    gives no rows.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return settled(docs.sparkSession, lambda: (_linked(docs, percent),), "components")[0]


def _sets_and_classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_id) of every document, and the distinct sets with what they are compared by."""
    marked = checkpoint(signatures(docs, percent), "signatures")
    classes = marked.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("c"), F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    return marked.select("doc_id", "n_shingles", "set_id"), classes


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    marked, classes = settled(docs.sparkSession, lambda: _sets_and_classes(docs, percent), "sets", "classes")
    banded = classes.select(F.explode("bands").alias("key"), "c", "n")
    leads = banded.groupBy("key").agg(F.min("c").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = classes.select(F.col("c").alias("leader"), F.col("n").alias("leader_n"))
    # classes that share a bucket, once for each leader they have
    members = checkpoint(banded.join(checkpoint(leads, "buckets"), "key").select("leader", "c", "n").distinct(), "members")
    star = members.where("c <> leader").select(F.col("c").alias("doc"), "leader", "n")
    star = checkpoint(star.join(sizes, "leader").where(_alike_in_size(F.col("n"), F.col("leader_n"), percent)).select("doc", "leader"), "star")
    edges = checkpoint(verify(docs, star, percent), "links")
    roots = components(edges)
    labelled = members.join(roots, F.col("c") == F.col("node"), "left").select("leader", "c", "n", F.coalesce("root", "c").alias("root"))
    mixed = labelled.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("leader")
    shown = labelled.join(mixed, "leader").hint("merge").join(classes.select("c", "signature", "sketch"), "c")  # open groups only
    more = checkpoint(verify(docs, open_pairs(checkpoint(shown, "labelled"), star, percent), percent), "links")
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    named = checkpoint(classes.select("set_id", "c").join(roots, F.col("c") == F.col("node"), "left").select(
        "set_id", "c", F.coalesce("root", "c").alias("root")), "named")
    joined = marked.join(named, "set_id", "left")
    lone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("root"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("c")).alias("class_id"))
