"""URL rules by a cascade of Bloom filters, exact over the keys of a corpus.

A rule is a host and the start of a path. A URL is looked up under every pair of (its host or
a parent domain, a start of its path as long as some rule's path). All such pairs of a corpus
are its key universe. Level 0 of a cascade holds the listed keys, level 1 those keys of the
universe that pass level 0 without being listed, level 2 the listed keys that pass level 1,
and so on until a level has no false positives. The first level that a key fails tells
whether it is listed, so URLs are judged in a plain scan.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.session import checkpoint

BITMAP_BITS = 32768  # bits of one row of Spark's bitmap aggregates
MAX_FILTER_BYTES = 64 << 20  # most bytes of filters sent to a task at once
MAX_LEVELS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _parents(host: Column) -> Column:
    """The host and its parent domains, longest first; an empty host has none."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Lookup keys of a URL, those of longer rules first, longer hosts first among equals."""
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(_parents(host), lambda h: F.transform(starts, lambda p: F.struct(
        (-F.length(h) - F.length(p)).alias("rank"), (-F.length(h)).alias("host_rank"), F.concat(h, p).alias("key"), F.length(h).alias("host_length")))))
    return F.array_sort(pairs)


@dataclass
class Level:
    """One Bloom filter: its bits and their number."""
    bits: np.ndarray  # bytes, lowest bit first
    size: int
    probes: int

    def has(self, key: np.ndarray, level: int) -> np.ndarray:
        """Which hashed keys pass."""
        ok = np.ones(len(key), bool)
        for place in _places(key, level, self.size, self.probes):
            ok &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return ok


def _places(key: np.ndarray, level: int, size: int, probes: int):
    for probe in range(probes):
        x = key ^ np.uint64(((level * 64 + probe + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def _shape(count: int, others: int) -> tuple[int, int]:
    """(bits, probes) of a filter over ``count`` keys that lets about as many of ``others`` pass."""
    probes = min(32, max(4, math.ceil(math.log2(max(others, 1) / max(count, 1) + 1))))
    return max(1, -(-int(1.45 * probes * count) // BITMAP_BITS)) * BITMAP_BITS, probes


def _level_rows(keys: DataFrame, level: int, size: int, probes: int) -> DataFrame:
    """The bits of one level, gathered by Spark as rows of BITMAP_BITS bits."""
    def places(batches):
        for batch in batches:
            key = batch.column("hash").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(_places(key, level, size, probes))))], names=["place"])
    bits = keys.select("hash").mapInArrow(places, "place long")
    return bits.groupBy((F.col("place") / BITMAP_BITS).cast("long").alias("block")).agg(
        F.bitmap_construct_agg((F.col("place") % BITMAP_BITS)).alias("bits"))


def _build_level(keys: DataFrame, level: int, others: int) -> Level:
    size, probes = _shape(keys.count(), others)
    if size // 8 > MAX_FILTER_BYTES:
        raise ValueError("a shard's filter is over the bound; pass more shards")
    bits = np.zeros(size // 8, np.uint8)
    width = BITMAP_BITS // 8
    for row in _level_rows(keys, level, size, probes).toLocalIterator():  # bytes bounded just above
        bits[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return Level(bits, size, probes)


def _passing(keys: DataFrame, filters: Level, level: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(filters)

    def pick(batches):
        for batch in batches:
            key = batch.column("hash").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(shared.value.has(key, level)))
    return keys.mapInArrow(pick, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Filters that tell exactly which keys of ``universe`` are in ``listed`` (both: hash, key).

    Keys never reach the driver; each level is gathered as bitmaps and the keys still in
    question shrink at every level.
    """
    inside = listed.select("hash").distinct()
    levels: list[Level] = []
    side, other = inside, None
    while len(levels) < MAX_LEVELS:
        n = len(levels)
        levels.append(_build_level(side, n, universe.count() if other is None else other.count()))
        if other is None:  # keys of the corpus that pass level 0 without being listed; one group per key, no join
            passed = _passing(universe.select("hash"), levels[0], 0).withColumn("listed", F.lit(0))
            both = passed.unionByName(inside.withColumn("listed", F.lit(1)))
            wrong = both.groupBy("hash").agg(F.max("listed").alias("listed")).where("listed = 0").select("hash")
        else:
            wrong = _passing(other, levels[n], n)
        wrong = checkpoint(wrong, "cascade")
        if wrong.isEmpty():
            return levels
        side, other = wrong, side
    raise ValueError("hash collision between a listed key and another key")


def look_up(levels: list[Level], key: np.ndarray) -> np.ndarray:
    """Exact membership of hashed keys of the universe."""
    listed = np.zeros(len(key), bool)
    open_ = np.arange(len(key))
    for n, level in enumerate(levels):
        passed = level.has(key[open_], n)
        listed[open_[~passed]] = n % 2 == 1  # failing an even level: not listed
        open_ = open_[passed]
    listed[open_] = len(levels) % 2 == 1
    return listed


def _rules(rules: DataFrame) -> DataFrame:
    """One row per rule key; a key listed both ways is blocked."""
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path")
        .agg(F.max(F.col("verdict")).alias("verdict"))  # 'block' sorts after 'allow'
        .select("verdict", _hash(F.concat("host", "path"), F.length("host")).alias("hash"), F.length("path").alias("n")))


def _hash(key: Column, host_length: Column) -> Column:
    return F.xxhash64(key, host_length.cast("int"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict of every page: (page_id, host, path, rule, verdict).

    ``rules`` has host, path and verdict (allow or block). The longest rule that fits wins, a
    longer host among equally long ones, block if one key is listed both ways; pages without
    rule get ``default``. Null URLs and those without ``://`` have an empty host and path and
    no rule. Repeated pages are judged one by one; an empty table gives no rows; other columns
    are left out.

    Two cascades (allowed keys, blocked keys) are broadcast. A list too long for
    ``MAX_FILTER_BYTES`` is cut by key hash into shards that are probed one after the other.
    """
    spark = pages.sparkSession
    listed = checkpoint(_rules(rules), "rules")
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())  # path lengths of rules: few, below the longest URL
    host, path = split_url(F.col("url"))
    if not lengths:
        return pages.select("page_id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    hashed = F.transform("keys", lambda k: _hash(k["key"], k["host_length"]))
    universe = checkpoint(urls.select(F.explode(hashed).alias("hash")).distinct(), "universe")
    shards = -(-2 * _shape(listed.count(), universe.count())[0] // (8 * MAX_FILTER_BYTES))
    found = urls.select("page_id", "host", "path", F.transform("keys", lambda k: k["key"]).alias("keys"), hashed.alias("hashes"))
    for name in ("allow", "block"):
        found = found.withColumn(name, F.lit(-1))
    for shard in range(shards):
        mine = F.pmod(F.col("hash"), F.lit(shards)) == shard
        part = {v: cascade(listed.where(mine & (F.col("verdict") == v)), universe.where(mine)) for v in ("allow", "block")}
        found = _probe(spark, found, part, shard, shards)
        if shard + 1 < shards:
            found = checkpoint(found, "probed")
    return _verdicts(found, default)


def _verdicts(found: DataFrame, default: str) -> DataFrame:
    # keys are sorted, so the smaller place is the better rule; -1 is none
    allow, block = F.col("allow"), F.col("block")
    best = F.when(allow < 0, block).when(block < 0, allow).otherwise(F.least(allow, block))
    return found.select(
        "page_id", "host", "path", F.when(best >= 0, F.get(F.col("keys"), best)).alias("rule"),
        F.when(best < 0, F.lit(default)).when(best == block, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def _probe(spark: SparkSession, found: DataFrame, part: dict[str, list[Level]], shard: int, shards: int) -> DataFrame:
    """Takes the first listed key of every page from this shard's cascades into allow and block."""
    shared = spark.sparkContext.broadcast(part)
    schema = found.schema

    def probe(batches):
        for batch in batches:
            lists = batch.column("hashes")
            key = lists.flatten().to_numpy().view(np.uint64)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            place = np.arange(len(key)) - ends[row]
            mine = np.flatnonzero(key.view(np.int64) % shards == shard)
            out = batch
            for name, levels in shared.value.items():
                hit = mine[look_up(levels, key[mine])]
                first = np.full(len(ends) - 1, np.iinfo(np.int32).max, np.int64)
                np.minimum.at(first, row[hit], place[hit])
                old = batch.column(name).to_numpy()
                old = np.where(old < 0, np.iinfo(np.int32).max, old)
                new = np.minimum(old, first)
                new = np.where(new == np.iinfo(np.int32).max, -1, new).astype(np.int32)
                out = out.set_column(out.schema.get_field_index(name), name, pa.array(new))
            yield out
    return found.mapInArrow(probe, schema)
