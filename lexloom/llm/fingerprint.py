"""Fingerprints of documents by a homomorphic multiset hash, with DataFrame functions only.

A text is the multiset of its paragraphs (sentences, long ones cut). Every paragraph hashes to
a wide vector and the fingerprint is the sum of the vectors, each lane modulo 2^20: the order
of paragraphs does not matter, and a paragraph's vector can be added or taken away. Three
lanes and their guard bits share a BIGINT, so one addition serves three lanes. There are a
lane that counts paragraphs, six lanes of hash bits that make equality safe (120 bits), and
108 lanes that count single hash bits: centred, they are random signs, and the cosine of two
fingerprints estimates how much the two multisets have in common.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.operators.rows import computed

PARAGRAPH_CHARS = 64  # a sentence is cut into pieces of so many characters at most
PARAGRAPH = r"[^.!?\n]{1,%d}[.!?\n]*|[.!?\n]+" % PARAGRAPH_CHARS
SHIFTS = 18  # counting BIGINTs from each half of the digest
WIDTH = 3 + 2 * SHIFTS
LANE = (1 << 20) - 1
ONES = 1 | 1 << 21 | 1 << 42
LANES = LANE * ONES
GUARDS = (LANE + 1) * ONES
ROWS_PER_BUCKET = 4000
MAX_BUCKETS = 20_000


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; none for null or empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")


def _spread(half: Column) -> Column:
    return (half.bitwiseAND(LANE) + F.shiftleft(F.shiftright(half, 20).bitwiseAND(LANE), 21) + F.shiftleft(F.shiftright(half, 40), 42))


def vector(paragraph: Column) -> Column:
    """Vector of one paragraph."""
    def lanes(h):
        a, b = h["a"], h["b"]
        bits = [F.shiftright(half, k).bitwiseAND(F.lit(ONES)) for half in (a, b) for k in range(SHIFTS)]
        return F.array(F.lit(1).cast("bigint"), _spread(a), _spread(b), *bits)
    digest = F.array(F.md5(paragraph))
    halves = F.transform(digest, lambda d: F.struct(_half(d, 1).alias("a"), _half(d, 17).alias("b")))
    return F.get(F.transform(halves, lanes), F.lit(0))


def add(left: Column, right: Column) -> Column:
    """Fingerprint of both multisets together (insertion)."""
    return F.zip_with(left, right, lambda x, y: (x + y).bitwiseAND(F.lit(LANES)))


def remove(left: Column, right: Column) -> Column:
    """Fingerprint of ``left`` without the paragraphs of ``right`` (deletion)."""
    return F.zip_with(left, right, lambda x, y: (x + F.lit(GUARDS) - y).bitwiseAND(F.lit(LANES)))


def fingerprint(text: Column) -> Column:
    """Sum of the paragraphs' vectors, an array of BIGINT; all zero for null or empty."""
    nothing = F.array_repeat(F.lit(0).cast("bigint"), WIDTH)
    return F.aggregate(F.transform(paragraphs(text), vector), nothing, add)


def as_text(lanes: Column) -> Column:
    """Lower-case hex, 16 digits a BIGINT."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: cosine of the signed counting lanes; 1 for equal fingerprints, 0 beside an empty one."""
    def signed(fp):
        n = F.get(fp, F.lit(0)).bitwiseAND(LANE)
        return F.flatten(F.transform(F.slice(fp, 4, 2 * SHIFTS), lambda v: F.array(*[
            2 * F.shiftright(v, s).bitwiseAND(LANE) - n for s in (0, 21, 42)])))

    def total(values):
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double")
    x, y = signed(left), signed(right)
    dot = total(F.zip_with(x, y, lambda a, b: a * b))
    size = F.sqrt(total(F.transform(x, lambda a: a * a))) * F.sqrt(total(F.transform(y, lambda b: b * b)))
    return F.when(left == right, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / size)), 6))


def _bucket(key: Column, bounds: list) -> Column:
    """Number of bounds not above the key, by halving; null counts as below all."""
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    array = F.lit(bounds)
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, columns: list[str], mark: Callable[[DataFrame], DataFrame], prefix: str = "next_") -> DataFrame:
    """Every document beside the next one in descending (doc_id, hash of the text); the last is followed by the first.

    ``docs`` has doc_id and text. ``mark`` adds columns row by row once the ranges are known,
    and ``columns`` are wanted of the next document. Rows
    are dealt out by ranges of doc_id; the first row of every range is also sent to the range
    before it, so that no window spans the table. Null doc_ids come last; equal rows follow
    each other.
    """
    keyed = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = docs.count()
    wanted = min(MAX_BUCKETS, n // ROWS_PER_BUCKET)
    bounds: list = []
    if wanted > 1:  # at most MAX_BUCKETS numbers
        shares = [i / wanted for i in range(1, wanted)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 20 * wanted)).first()[0]))
    placed = keyed.withColumn("__bucket", _bucket(F.col("doc_id"), bounds) if bounds else F.lit(0)).withColumn("__extra", F.lit(0))
    # struct order: nulls are the smallest, so the largest is the first row in descending order
    heads = placed.groupBy("__bucket").agg(F.max(F.struct("doc_id", "__hash")).alias("head"))
    down = Window.orderBy(F.desc("__bucket"))  # one row per range
    before = F.coalesce(F.lag("__bucket").over(down), F.lit(-1))  # the range that ends where this one starts
    last = heads.agg(F.min("__bucket").alias("last"))
    turned = heads.select("head", before.alias("before")).join(F.broadcast(last)).select(
        F.when(F.col("before") < 0, F.col("last")).otherwise(F.col("before")).alias("before"),
        F.col("head.doc_id").alias("__id"), F.col("head.__hash").alias("__h"))
    extra = (
        keyed.join(F.broadcast(turned), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")))
        .drop("__id", "__h").withColumnRenamed("before", "__bucket").withColumn("__extra", F.lit(1))
        .dropDuplicates(["__bucket"]))
    order = Window.partitionBy("__bucket").orderBy("__extra", F.desc("doc_id"), F.desc("__hash"))
    both = mark(placed.unionByName(extra))
    return both.withColumns({prefix + c: F.lead(c).over(order) for c in columns}).where("__extra = 0").drop("__bucket", "__extra", "__hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are.

    Needs doc_id and text, reads nothing else. The edited text has its last third (floor of a
    third of the code points) replaced by the beginning of the next document, of which as many
    code points are taken, or all there are. A null text counts as empty, an empty text has no
    paragraphs and a fingerprint of zeros; repeated rows are kept one by one and follow each
    other; a single document follows itself; an empty table gives no rows.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(plain, ["text", "lanes"], lambda rows: computed(rows, "lanes", fingerprint(F.col("text"))))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = computed(paired.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), size - third), F.substring(F.col("next_text"), F.lit(1), third))), "edited_lanes", fingerprint(F.col("edited")))
    return edited.select(
        "doc_id", size.cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
