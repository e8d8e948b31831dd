"""Mixes sources of documents to target shares of words.

Efraimidis-Spirakis sampling: a document draws u from a hash of its id and text and gets the
exponential key -ln(u) / quality, so a better document tends to come earlier. Within a source
documents stand in the order of their keys and their sizes are summed up. A source takes as many
complete epochs as its target holds; the rest of the target is a budget of words that the first
documents in order fill, the last of them giving only its first words.

Sources are cut into buckets of keys with about BUCKET_ROWS documents each, so the largest
source is sorted by as many tasks as it has buckets. Only sums leave a bucket.

Defined cases: a null text or one without words has size 0 and takes 0. A null source is a source
of its own and the last in order. A null, NaN or missing quality counts as 1, one of zero or less
as MIN_QUALITY. Rows with a null or repeated doc_id are documents of their own; rows equal in id
and text are interchangeable. An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.operators.ordered import running_sum
from lexloom.session import checkpoint, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
MIN_QUALITY = 1e-6
BUCKET_ROWS = 5_000
_DRAWS = float((1 << 52) + 2)  # keys are drawn from 52 bits


def _source_key() -> Column:
    """A name of fixed length for a source; null has its own."""
    return F.coalesce(F.md5(F.col("source").cast("binary")), F.lit("-"))


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the weights in turn over the sources by code point, null last.

    Sources are numbered range by range; only one count per range meets in one task.
    """
    ranged = checkpoint(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select(
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    return ranged.join(before, "part").withColumn("weight", turn.cast("long")).drop("part", "before")


def with_targets(sources: DataFrame, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``: a weighted share of all words, at most ``max_epochs`` times the source.

    What a capped source leaves over is shared again by weight among the others, in rounds that
    aggregate one row each, until no source is above its cap.
    """
    cap = F.col("source_size") * max_epochs
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, open_weight = int((total or 0) * share), weight or 1
    capped = (0, 0)
    while True:
        rate = F.lit(float(goal - capped[0])) / F.lit(float(open_weight))
        found = sources.where(cap < rate * F.col("weight")).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if tuple(found) == capped or found[1] >= (weight or 0):
            break
        capped, open_weight = tuple(found), weight - found[1]
    share_of = (F.lit(goal - capped[0]) * F.col("weight")).cast("double") / F.lit(float(open_weight))
    return sources.withColumn("target", F.least(cap.cast("double"), share_of))


def mix(docs: DataFrame, quality: Column | None = None, keep: tuple[str, ...] = ("doc_id",), share: float = 1.0,
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, marks: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` of every document with size, source_size, target, quality, epochs and taken.

    ``quality`` is a column over ``docs``; in its place ``marks`` (doc_id once, quality) gives the
    quality of documents, joined where texts are measured already. ``epochs`` are the complete
    passes of the source, ``taken`` the words the mix takes of the document, repeats counted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text).cast("binary")), 1, 13), 16, 10)
    rows = checkpoint(docs.select(
        F.struct(*keep).alias("kept"), "source", _source_key().alias("source_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.lit(1.0) if quality is None else quality).cast("double").alias("quality"), F.col("doc_id").alias("__id"),
        (-F.log((draw.cast("long") + 1).cast("double") / F.lit(_DRAWS))).alias("draw")), "mix")
    if marks is not None:
        rows = rows.drop("quality").join(marks.select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("quality")), "__id", "left")
    worth = F.col("quality")
    rows = rows.withColumn("quality", F.when(worth.isNull() | F.isnan(worth), 1.0).when(worth <= 0, MIN_QUALITY).otherwise(worth))
    rows = rows.withColumn("draw", F.col("draw") / F.col("quality")).drop("__id")
    sources = rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = with_targets(checkpoint(weighted(sources, weights), "weights"), share, max_epochs)
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("budget", whole - F.col("epochs") * F.col("source_size")).drop("source", "weight")
    placed = rows.drop("source").join(small(goals), "source_key").withColumn("id", F.col("kept")[keep[0]])
    bucket = F.floor(F.ceil(F.col("n") / BUCKET_ROWS) * (1 - F.exp(-F.col("draw")))).cast("long")
    summed = running_sum(placed, ["source_key"], ["draw", "id"], F.col("size"), "upto", bucket)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - (F.col("upto") - F.col("size"))))
    return summed.select("kept.*", "size", "source_size", "target", "quality", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def draw_texts(docs: DataFrame, quality: Column | None = None, **options) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs`` once per pass, with ``pass`` from 1.

    Complete passes have the text as it is; a last partial pass has its first words, joined by
    single spaces. Documents of which nothing is taken are left out.
    """
    mixed = mix(docs, quality, ("doc_id", *[c for c in docs.columns if c != "doc_id"]), **options)
    rest = F.col("taken") - (F.col("pass") - 1) * F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, rest.cast("int")), " ")
    passes = mixed.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    return passes.select(*[F.when(rest >= F.col("size"), F.col("text")).otherwise(first).alias("text") if c == "text" else F.col(c) for c in docs.columns], "pass")
