"""Documents packed into token sequences by a grouping genetic algorithm on islands.

Texts become token pieces no longer than a sequence. Pieces are dealt into shards of bounded
size, and every shard is packed by several islands: populations of packings that evolve in
separate tasks. A gene is a whole bin. Crossover puts well-filled bins of one parent into the
other, takes out the bins that now hold a piece twice, and best-fits what they leave over.
After each epoch the best packings of an island move to the next island of the shard.
"""
from __future__ import annotations

import json
import os
import random
import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lexloom.llm import words
from lexloom.session import checkpoint

CAPACITY = 2048
SHARD_PIECES = 4096  # expected pieces of a shard
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8  # of an epoch
POPULATION = 6
ELITES = 2  # packings that move on
CACHED_WORDS = 600_000
JOINED_WORDS = 256  # encoded in one call
SLICE_BYTES = 16 << 20
END = 0  # id after every document

#: a normalizer and pre-tokenizer that fold case, keep no white space and encode letters and punctuation apart
_FOLDED = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_RUNS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Latin and Cyrillic letters that normalization leaves alone and whose small form is one letter, then ASCII punctuation
_CUT = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-įı-ɏЀ-ҁ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


class WordIds:
    """Token ids of blank-separated words; the tokenizer never joins characters across white space.

    Where the tokenizer's file says that case does not matter and that letters and punctuation are
    encoded apart, words are looked up as a stem in small letters and the punctuation behind it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._last = _last_tokens(path)
        self._known: dict[str, int] = {}  # part of a word -> its place in _sizes
        self._ids, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def of(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        if self._last is None:
            stems, tails = vocabulary, pa.array([], vocabulary.type)
        else:
            cut = pc.extract_regex(vocabulary, _CUT)
            stems, tails = pc.coalesce(pc.ascii_lower(pc.struct_field(cut, "stem")), vocabulary), pc.coalesce(pc.struct_field(cut, "tail"), "")
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        before = len(self._known), self._ids, self._sizes
        parts = self._places(stems.dictionary)[stems.indices.to_numpy()]
        if len(tails):
            parts = np.c_[parts, self._places(tails.dictionary)[tails.indices.to_numpy()]].ravel()
        sizes = self._sizes[parts]
        flat = _gathered(self._ids, (np.cumsum(self._sizes) - self._sizes)[parts], sizes)
        if len(self._known) > CACHED_WORDS:  # what this call added is forgotten
            self._known = dict(islice(self._known.items(), before[0]))
            self._ids, self._sizes = before[1:]
        return flat, sizes.reshape(len(vocabulary), -1).sum(axis=1) if len(vocabulary) else sizes

    def _places(self, parts: pa.Array) -> np.ndarray:
        parts, known = parts.to_pylist(), self._known
        new = [w for w in parts if w not in known]
        letters = [w for w in new if w.isalpha()] if self._last is not None else []
        others = [w for w in new if not w.isalpha()] if self._last is not None else new
        ids, sizes = [self._ids], [self._sizes]
        for some, (got, lengths) in chain(self._together(letters), self._alone(others)):
            known.update(zip(some, range(len(known), len(known) + len(some))))
            ids.append(got)
            sizes.append(lengths)
        self._ids, self._sizes = np.concatenate(ids), np.concatenate(sizes)
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def _alone(self, some: list[str]):
        """(words, (ids of all, number of ids of each)), every word encoded by itself."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        yield some, (np.fromiter(chain.from_iterable(found), np.uint32, lengths.sum()), lengths)

    def _together(self, letters: list[str]):
        """The same, encoded many at a time. Every word ends in a token that can only be a last one,
        so as many of these as words means one for each."""
        groups = [letters[i:i + JOINED_WORDS] for i in range(0, len(letters), JOINED_WORDS)]
        for some, found in zip(groups, self._tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self._last[ids])
            if len(ends) == len(some):
                yield some, (ids, np.diff(ends, prepend=-1))
            else:  # some word is more than one run of letters to the tokenizer
                yield from self._alone(some)


def _last_tokens(path: str) -> np.ndarray | None:
    """Which ids end a run of characters that is encoded by itself; None if the file does not say so of letters."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    if (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"]) != (_FOLDED, _RUNS, None) or model["type"] != "BPE" or not suffix or suffix.isalpha():
        return None
    from tokenizers.pre_tokenizers import ByteLevel
    if any(c + end not in model["vocab"] for c in ByteLevel.alphabet() for end in ("", suffix)):
        return None  # characters could be lost
    if not all(re.match(r"[!-/:-@\[-`{-~]+[A-Za-z]", t["content"]) for t in spec["added_tokens"]):
        return None  # a special token could lie in a stem and its tail
    last = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1, bool)
    last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
    return last


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i] + sizes[i]] of every i, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_tokenizers: dict[str, WordIds] = {}  # one per worker process


def document_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): ids of all texts, each ended by END; text i has ids[bounds[i]:bounds[i + 1]]."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        _tokenizers[path] = WordIds(path)
    tokenizer = _tokenizers[path]
    codes, bounds, vocabulary = words.split(texts)
    flat, lengths = tokenizer.of(vocabulary)
    flat = np.r_[flat, np.uint32(END)].astype(np.uint32)
    lengths = np.r_[lengths, 1]
    codes = np.insert(codes, bounds[1:], len(vocabulary))  # the end mark is one more word
    size = lengths[codes]
    ids = _gathered(flat, (np.cumsum(lengths) - lengths)[codes], size)
    return ids, np.r_[0, np.cumsum(size)][bounds + np.arange(len(bounds))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every document: (doc_id, piece, start, length, ids_crc32).

    Only documents of more than ``capacity`` ids are cut. A null or empty text has one id, END.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in words.slices(batches, max_bytes=SLICE_BYTES):
            ids, bounds = document_ids(batch.column("text"), path)
            ids = ids.astype("<u4")
            n = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(bounds)[row] - start)
            at = bounds[:-1][row] + start
            crc = [zlib.crc32(ids[a:a + k]) for a, k in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """A packing under construction: bins with room, found by the smallest room that fits."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set if some bin has room r

    def open(self, bin_: list[int], room: int) -> None:
        self.bins.append(bin_)
        self.room.append(room)
        self._offer(len(self.bins) - 1)

    def _offer(self, b: int) -> None:
        self.by_room.setdefault(self.room[b], []).append(b)
        self.rooms |= 1 << self.room[b]

    def best_fit(self, items: list[int]) -> None:
        """Puts the items, in this order, where least room is left over; opens bins as needed."""
        for item in items:
            size = self.lengths[item]
            fits = self.rooms >> size
            if not fits:
                self.open([item], self.capacity - size)
                continue
            room = size + (fits & -fits).bit_length() - 1
            stack = self.by_room[room]
            b = stack.pop()
            if not stack:
                self.rooms ^= 1 << room
            self.bins[b].append(item)
            self.room[b] = room - size
            self._offer(b)


class Island:
    """A population of packings of the same pieces."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.population: list[tuple[tuple, list[list[int]]]] = []

    def _rated(self, bins: list[list[int]]):
        fill = [sum(self.lengths[i] for i in b) for b in bins]
        return (len(bins), -sum(f * f for f in fill)), bins  # fewer bins, then fuller ones

    def start(self, size: int) -> None:
        """Best fit in falling order, and the same with the order shaken."""
        order = range(len(self.lengths))
        for k in range(size):
            shake = 0.0 if k == 0 else 0.15 * k / size
            key = {i: self.lengths[i] * (1 + shake * self.random.random()) for i in order}
            made = Bins(self.lengths, self.capacity)
            made.best_fit(sorted(order, key=key.__getitem__, reverse=True))
            self.population.append(self._rated(made.bins))
        self.population.sort(key=lambda p: p[0])

    def admit(self, assignments: list[list[int]]) -> None:
        """Packings given as the bin of every piece."""
        for bins_of in assignments:
            bins: dict[int, list[int]] = {}
            for item, b in enumerate(bins_of):
                bins.setdefault(b, []).append(item)
            self.population.append(self._rated(list(bins.values())))
        self.population.sort(key=lambda p: p[0])

    def _crossed(self, base: list[list[int]], donor: list[list[int]]) -> list[list[int]]:
        size = self.lengths
        full = sorted(donor, key=lambda b: -sum(size[i] for i in b))
        chosen = [b for b in full[:max(1, 2 * len(full) // 3)] if self.random.random() < 0.5]
        taken = {i for b in chosen for i in b}
        made, loose = Bins(size, self.capacity), []
        for b in chosen:
            made.open(list(b), self.capacity - sum(size[i] for i in b))
        worst = max((self.capacity - sum(size[i] for i in b) for b in base), default=0)
        for b in base:
            room = self.capacity - sum(size[i] for i in b)
            if taken.isdisjoint(b) and not (room > worst // 2 and room > 0 and self.random.random() < 0.5):
                made.open(list(b), room)
            else:  # holds a piece twice, or is opened up as a mutation because it is poorly filled
                loose += [i for i in b if i not in taken]
        made.best_fit(sorted(loose, key=lambda i: -size[i]))
        return made.bins

    def evolve(self, generations: int, size: int) -> None:
        perfect = -(-sum(self.lengths) // self.capacity)
        for _ in range(generations):
            if self.population[0][0][0] <= perfect:
                break
            base, donor = self.random.sample(self.population[:size], 2) if len(self.population) > 1 else (self.population[0],) * 2
            self.population.append(self._rated(self._crossed(base[1], donor[1])))
            self.population.sort(key=lambda p: p[0])
            del self.population[size:]

    def best(self, count: int) -> list[tuple[list[int], int, int]]:
        found = []
        for rated, bins in self.population[:count]:
            of = [0] * len(self.lengths)
            for b, items in enumerate(bins):
                for i in items:
                    of[i] = b
            found.append((of, rated[0], rated[1]))
        return found


_STATE = "shard long, island int, lengths array<int>, packings array<struct<bins:array<int>, n:int, fill:long>>"


def _epoch(capacity: int, generations: int, population: int, first: bool):
    def run(batches):
        for batch in batches:
            packings = []
            for row in batch.to_pylist():
                island = Island(row["lengths"], capacity, row["shard"] * 1009 + row["island"] * 2 + first)
                if first:
                    island.start(population)
                else:
                    island.admit([p["bins"] for p in row["packings"]])
                island.evolve(generations, population)
                packings.append([{"bins": of, "n": n, "fill": fill} for of, n, fill in island.best(population)])
            kind = batch.schema.field("packings").type
            yield batch.set_column(batch.schema.get_field_index("packings"), "packings", pa.array(packings, kind))
    return run


def evolve(shards: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS,
           generations: int = GENERATIONS, population: int = POPULATION, elites: int = ELITES) -> DataFrame:
    """Best packing of every shard: (shard, lengths) -> (shard, bins), bins[i] being the bin of piece i."""
    empty = F.array().cast("array<struct<bins:array<int>, n:int, fill:long>>")
    state = shards.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", empty.alias("packings"))
    state = checkpoint(state.repartition("shard", "island").mapInArrow(_epoch(capacity, generations, population, True), _STATE), "islands")
    for _ in range(epochs - 1):
        moved = state.select(
            "shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.lit(None).cast("array<int>").alias("lengths"),
            F.slice("packings", 1, elites).alias("packings"))
        met = state.unionByName(moved).groupBy("shard", "island").agg(
            F.max("lengths").alias("lengths"), F.flatten(F.collect_list("packings")).alias("packings"))  # population + elites
        state = checkpoint(met.mapInArrow(_epoch(capacity, generations, population, False), _STATE), "islands")
    best = state.select("shard", F.get("packings", F.lit(0)).alias("p"))
    return best.groupBy("shard").agg(F.min_by("p.bins", F.struct("p.n", "p.fill")).alias("bins"))


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset added.

    Every piece gets a place, repeated rows one each; nothing is dropped. Pieces of
    ``capacity`` fill a sequence alone and need no search. An empty table gives no rows.
    """
    cut = checkpoint(cut.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")  # tokenized once
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    gathered = checkpoint(dealt.groupBy("shard").agg(F.collect_list(item).alias("items")), "shards")  # about shard_pieces in each
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    best = evolve(gathered.select("shard", lengths.alias("lengths")), capacity)
    placed = gathered.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    rows = placed.select("shard", "x.items.*", F.col("x.bins").alias("bin"))
    return _offsets(rows)


def _offsets(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("shard", "bin").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` ids.

    Needs doc_id and text; other columns are not read. Null doc_ids are kept.
    """
    return pack(pieces(docs, path, capacity), capacity)
