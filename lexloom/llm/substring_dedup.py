"""Removes long passages that a document with a smaller doc_id holds word for word.

Fixed-block anchors: the index holds the non-overlapping blocks of BLOCK words of every
document, and every rolling window of BLOCK words probes it. A passage of WINDOW words always
contains a whole block of the document it repeats, as WINDOW >= 2 * BLOCK - 1. Around hits,
windows of WINDOW words are compared corpus-wide; runs of repeated windows are the maximal
exact repeats, and all words they cover go.

Documents are dealt once into groups of a few megabytes, and a group sends every hash once,
however many of its documents share it, as sorted arrays cut by hash range. So a passage found
in a third of all documents is one entry per group, not one per document.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexloom.llm import words
from lexloom.session import checkpoint, shared_dir

WINDOW, BLOCK = 50, 25
GROUP_CHARS = 8 << 20
GROUPS_PER_FILE = 3
RANGE_WORDS = 2 << 20  # entries of one hash range, about
_U64 = np.uint64
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW_BITS = 40  # second part of a window's name; the first has 56 bits
_CELLS = "part int, grp int, names binary, more binary, docs binary, flags binary"
_ANSWERS = "grp int, kind int, part int, names binary, docs binary"


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes: planes of zeros shrink to nothing in the shuffle."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=_U64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=_U64)


class _Group:
    """Words of the documents of one group; rows without doc_id index nothing."""

    def __init__(self, table: pa.Table, bits: int):
        texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        codes, self.bounds, vocabulary = words.split(texts)
        ids = table.column("doc_id")
        known = pc.is_valid(ids).to_numpy()
        self.doc = pc.fill_null(ids, 0).to_numpy().astype(np.int64)
        self.word_hash = words.hashes(vocabulary)[codes] if len(codes) else np.zeros(0, _U64)
        self.row = words.row_of(self.bounds)
        n = len(codes)
        row_end = self.bounds[1:][self.row] if n else np.zeros(0, np.int64)
        usable = known[self.row] if n else np.zeros(0, bool)
        place = np.arange(n)
        self.anchor_at = np.flatnonzero(usable & (place + BLOCK <= row_end))
        self.window_at = np.flatnonzero(usable & (place + WINDOW <= row_end))
        self.rolled = [self._rolled(f) for f in _FACTORS]
        self.anchors = (words.mix(self.rolled[0][self.anchor_at]) >> _U64(64 - bits)) if n else np.zeros(0, _U64)
        self.aligned = (self.anchor_at - self.bounds[self.row[self.anchor_at]]) % BLOCK == 0 if n else np.zeros(0, bool)

    def _rolled(self, factor: int) -> np.ndarray:
        n = len(self.word_hash)
        padded = np.r_[self.word_hash, np.zeros(WINDOW, _U64)]
        total = np.zeros(n, _U64)
        for k in range(BLOCK):
            total = total * _U64(factor) + padded[k:n + k]
        return total

    def entries(self):
        """(sorted distinct anchors, whether a block starts there, whether several documents have it)."""
        order = np.argsort(self.anchors, kind="stable")
        value = self.anchors[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
        if not len(value):
            return value, np.zeros(0, bool), np.zeros(0, bool)
        doc = self.doc[self.row[self.anchor_at[order]]]
        return value[first], np.logical_or.reduceat(self.aligned[order], first), np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)

    def candidates(self, repeated: np.ndarray):
        """Windows around anchors that repeat: (starts, first names, second names)."""
        n = len(self.word_hash)
        hit = np.zeros(n + WINDOW + 1, np.int64)
        if len(repeated) and len(self.anchors):
            at = np.minimum(np.searchsorted(repeated, self.anchors), len(repeated) - 1)
            hit[1 + self.anchor_at[repeated[at] == self.anchors]] = 1
        before = np.cumsum(hit)
        start = self.window_at[before[self.window_at + WINDOW - BLOCK + 1] > before[self.window_at]]
        names = []
        for rolled, factor in zip(self.rolled, _FACTORS):
            names.append(words.mix(rolled[start] * _U64(pow(factor, BLOCK, 1 << 64)) + rolled[start + BLOCK]))
        return start, names[0] >> _U64(8), names[1] >> _U64(64 - _LOW_BITS)

    def windows(self, repeated: np.ndarray):
        """(starts, which distinct name each has, distinct names in order, smallest doc_id of each)."""
        start, high, low = self.candidates(repeated)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        which = np.zeros(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        doc = self.doc[self.row[start[order]]] if len(order) else np.zeros(0, np.int64)
        return start, which, high[first], low[first], np.minimum.reduceat(doc, first) if len(first) else doc


def _cuts(values: np.ndarray, bits: int, parts_log2: int):
    """Slices of a sorted array by the leading bits of its values."""
    part = values >> _U64(bits - parts_log2) if parts_log2 else np.zeros(len(values), _U64)
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(values) else np.zeros(0, np.int64)
    for a, b in zip(edge, np.r_[edge[1:], len(values)]):
        yield int(part[a]), slice(int(a), int(b))


def _cells(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "grp", "names", "more", "docs", "flags"])


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "kind", "part", "names", "docs"])


def _send_anchors(bits: int, parts_log2: int):
    def run(table: pa.Table) -> pa.Table:
        value, aligned, several = _Group(table, bits).entries()
        grp = table.column("__grp")[0].as_py()
        return _cells([(part, grp, _pack_sorted(value[s]), b"", b"", np.packbits(np.r_[aligned[s], several[s]]).tobytes())
                       for part, s in _cuts(value, bits, parts_log2)])
    return run


def _match_anchors(cells: pa.Table) -> pa.Table:
    """Anchors of a hash range that some document's block holds and a second document too, for each group that sent them."""
    names = [_unpack_sorted(x) for x in cells.column("names").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(v)).astype(bool) for f, v in zip(cells.column("flags").to_pylist(), names)]
    value = np.concatenate(names)
    aligned = np.concatenate([f[:len(v)] for f, v in zip(flags, names)])
    several = np.concatenate([f[len(v):] for f, v in zip(flags, names)])
    order = np.argsort(value, kind="stable")
    first = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
    size = np.diff(np.r_[first, len(value)])
    good = np.logical_or.reduceat(aligned[order], first) & ((size > 1) | np.logical_or.reduceat(several[order], first))
    keep = np.zeros(len(value), bool)
    keep[order] = np.repeat(good, size)
    out, at = [], 0
    for grp, part, v in zip(cells.column("grp").to_pylist(), cells.column("part").to_pylist(), names):
        mine = v[keep[at:at + len(v)]]
        at += len(v)
        if len(mine):
            out.append((grp, 0, part, _pack_sorted(mine), b""))
    return _answers(out)


def _repeated(answers: pa.Table) -> np.ndarray:
    found = sorted((p, n) for k, p, n in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "names"))) if k == 0)
    return np.concatenate([_unpack_sorted(n) for _, n in found]) if found else np.zeros(0, _U64)


def _send_windows(bits: int, parts_log2: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _cells([])
        _, _, high, low, doc = _Group(table, bits).windows(_repeated(answers))
        grp = table.column("__grp")[0].as_py()
        return _cells([(part, grp, _pack_sorted(high[s]), _pack(low[s]), _pack(doc[s].view(_U64)), b"") for part, s in _cuts(high, 56, parts_log2)])
    return run


def _match_windows(cells: pa.Table) -> pa.Table:
    """For each group the windows of which another group has a smaller document: (places in its cell, doc_ids)."""
    names = [_unpack_sorted(x) for x in cells.column("names").to_pylist()]
    high = np.concatenate(names)
    low = np.concatenate([_unpack(x) for x in cells.column("more").to_pylist()])
    doc = np.concatenate([_unpack(x) for x in cells.column("docs").to_pylist()]).view(np.int64)
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    least = np.zeros(len(high), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(high)]))
    out, at = [], 0
    for grp, part, v in zip(cells.column("grp").to_pylist(), cells.column("part").to_pylist(), names):
        mine = slice(at, at + len(v))
        at += len(v)
        smaller = np.flatnonzero(least[mine] < doc[mine])
        if len(smaller):
            out.append((grp, 1, part, _pack_sorted(smaller.astype(_U64)), _pack(least[mine][smaller].view(_U64))))
    return _answers(out)


def _remove(bits: int, parts_log2: int, names: list[str], plain: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        group = _Group(table, bits)
        start, which, high, _, least = group.windows(_repeated(answers))
        offset = {part: s.start for part, s in _cuts(high, 56, parts_log2)}
        for kind, part, places, docs in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "names", "docs"))):
            if kind == 1:
                least[offset[part] + _unpack_sorted(places).astype(np.int64)] = _unpack(docs).view(np.int64)
        gone = start[least[which] < group.doc[group.row[start]]] if len(start) else start
        cover = np.zeros(len(group.word_hash) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + WINDOW, -1)
        covered = np.cumsum(cover)[:-1] > 0
        removed = np.bincount(group.row[covered], minlength=table.num_rows) if len(covered) else np.zeros(table.num_rows, np.int64)
        texts = []
        for i, text in enumerate(table.column("text").to_pylist()):
            if removed[i] or (plain and text is not None):
                parts = text.encode().split()  # bytes: the same white space as in words.split
                if removed[i]:
                    parts = [p for p, c in zip(parts, covered[group.bounds[i]:group.bounds[i + 1]].tolist()) if not c]
                text = b" ".join(parts).decode()
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if n == "text" else table.column(n) for n in names]
        return pa.Table.from_arrays(columns + [pa.array(np.diff(group.bounds)), pa.array(removed.astype(np.int64))], names=names + ["n_words", "n_removed"])
    return run


def _grouped(docs: DataFrame, groups: int) -> DataFrame:
    """The documents dealt into groups once, as a bucketed table in the shared folder: later passes need no shuffle of texts."""
    spark = docs.sparkSession
    files = max(1, groups // GROUPS_PER_FILE)
    name, path = f"grouped_{uuid.uuid4().hex}", shared_dir(spark, "grouped")
    dealt = docs.withColumn("__grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(files, "__grp")
    dealt.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(files, "__grp").saveAsTable(name)
    table = spark.table(name)
    table.schema  # the plan now knows the files
    spark.sql(f"DROP TABLE {name}")  # forgets the name, keeps the files
    return table


def dedupe(docs: DataFrame, plain: bool = False) -> DataFrame:
    """``docs`` without repeated passages, plus n_words and n_removed.

    A passage of WINDOW words that also starts in a document with a smaller doc_id is removed
    from ``text``; the words left are joined by one blank. Texts that lose nothing stay as they are,
    unless ``plain`` asks for their words joined by one blank, too. A null text has no words and stays null,
    an empty one stays empty, texts of fewer than WINDOW words lose nothing. Rows without doc_id neither
    lose words nor count as a place where a passage starts; rows that repeat a doc_id do not
    remove words from each other. Other columns pass through; former n_words and n_removed
    are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed").withColumn("doc_id", F.col("doc_id").cast("long"))
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_words long, n_removed long"
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-chars // GROUP_CHARS))
    amount = max(2, chars // 4)  # words at most, roughly
    bits = min(56, 24 + math.ceil(math.log2(amount)))  # false hits stay rare at any size; windows are compared in full anyway
    parts_log2 = max(0, math.ceil(math.log2(amount / RANGE_WORDS)))
    table = _grouped(docs, groups)
    dealt = table.groupBy("__grp")
    anchors = dealt.applyInArrow(_send_anchors(bits, parts_log2), _CELLS)
    hits = checkpoint(anchors.groupBy("part").applyInArrow(_match_anchors, _ANSWERS), "anchors")
    windows = dealt.cogroup(hits.groupBy("grp")).applyInArrow(_send_windows(bits, parts_log2), _CELLS)
    smaller = checkpoint(windows.groupBy("part").applyInArrow(_match_windows, _ANSWERS), "windows")
    answers = hits.unionByName(smaller)
    return dealt.cogroup(answers.groupBy("grp")).applyInArrow(_remove(bits, parts_log2, names, plain), schema)
