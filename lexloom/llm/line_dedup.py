"""Deletes later copies of repeated runs of lines, with DataFrame functions only.

A text is the sequence of its non-blank lines, each known by a 128-bit ID. All suffixes of all
texts are put in order by prefix doubling: a suffix's rank is the number of suffixes whose first
w lines come before its own; ranks of 2w lines follow from sorting the pairs of ranks at a place
and w lines further on. Only tied suffixes that are not ranked to their end yet stay in the next round;
rounds go on until there are none. Pairs are counted before they are sorted by range, a range
knows only its own pairs, and what a tied group has in earlier ranges is carried on in one row per
range. Ranks of a text stay in one row, so the rank w lines on is looked up without a join.

Suffixes with equal ranks at w lines are an interval of the suffix array whose neighbours share w
lines or more; the ranks at ``min_lines`` lines thus name the intervals that hold every repeated
run of so many lines, and all members but the first are later copies. A maximal repeated run is
the union of these windows, so deleting the windows deletes the run. Lines of ``long_words``
words or more can be asked to count as runs by themselves: intervals of one line.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.operators.rows import computed
from lexloom.session import checkpoint, settled

MIN_LINES = 2
_SUFFIX = ["doc_id", "text_hash", "place"]


def line_ids(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """One row per non-blank line: doc_id, text_hash, place (from 0), n_lines, the line's ID (a, b), long.

    Rows equal in doc_id and text are one text; their lines come up repeatedly here and once in later rounds.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wide = F.lit(False) if long_words is None else F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= long_words
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    split = computed(texts.withColumn("text_hash", F.xxhash64("text")), "lines", lines).select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("place", "line"))
    return split.select(*_SUFFIX, "n_lines", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), wide.alias("long"))


def _ranked(pairs: DataFrame, second: list[str]) -> DataFrame:
    """(rank, *second, next, n) of every distinct pair: its rank in the order of (rank, *second), and how many suffixes have it."""
    counts = pairs.groupBy("rank", *second).agg(F.count(F.lit(1)).alias("n"))
    ranged = checkpoint(counts.repartitionByRange("rank", *second).withColumn("part", F.spark_partition_id()), "pairs")
    edges = ranged.groupBy("part").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    # a rank found in several ranges is the lowest or highest of each: two rows per range
    shared = ranged.join(F.broadcast(edges), "part").where("rank = low OR rank = high").groupBy("rank", "part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("rank").orderBy("part")) - F.col("n")
    carried = shared.select("rank", "part", earlier.alias("carried"))
    before = F.sum("n").over(Window.partitionBy("part", "rank").orderBy(*second)) - F.col("n")
    placed = ranged.withColumn("before", before).join(F.broadcast(carried), ["rank", "part"], "left")
    return placed.select("rank", *second, (F.col("rank") + F.col("before") + F.coalesce("carried", F.lit(0))).alias("next"), "n")


def _still_open(ranked: DataFrame, width: int) -> DataFrame:
    """Per text with suffixes that are tied beyond ``width`` lines: ranks of all its suffixes, and which are open."""
    entry = F.struct("place", F.col("next").alias("rank"), ((F.col("n") > 1) & (F.col("place") + width <= F.col("n_lines"))).alias("open"))
    # as many entries as the text has lines
    texts = ranked.groupBy("doc_id", "text_hash", "n_lines").agg(F.sort_array(F.collect_set(entry)).alias("suffixes"))
    return texts.where(F.exists("suffixes", lambda s: s["open"]))


def _merged(texts: DataFrame, ranked: DataFrame, width: int) -> DataFrame:
    """The texts with the new ranks of their open suffixes; texts without open ones drop out."""
    open_now = (F.col("n") > 1) & (F.col("place") + width <= F.col("n_lines"))
    news = ranked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", F.lit(0).alias("old"), F.col("next").alias("rank"), open_now.alias("open"))).alias("news"))
    olds = F.transform("suffixes", lambda s: F.struct(s["place"].alias("place"), F.lit(1).alias("old"), s["rank"].alias("rank"), F.lit(False).alias("open")))
    both = computed(texts.join(news, ["doc_id", "text_hash"]), "both", F.sort_array(F.concat("news", olds)))
    first = F.filter("both", lambda s, i: (i == 0) | (F.get("both", i - 1)["place"] != s["place"]))  # of a place, the new entry stands first
    merged = both.select("doc_id", "text_hash", "n_lines", F.transform(first, lambda s: F.struct(s["place"].alias("place"), s["rank"].alias("rank"), s["open"].alias("open"))).alias("suffixes"))
    return merged.where(F.exists("suffixes", lambda s: s["open"]))


def rounds(lines: DataFrame, min_lines: int = MIN_LINES, until: int | None = None):
    """Yields (width, suffixes): after each round the suffixes ranked in it, with rank ``next`` and the size ``n`` of their interval.

    The first round ranks all suffixes by one line, each later one the open suffixes only. Widths
    double, but for one that is ``min_lines`` itself. Ends when no suffix is tied, or at ``until`` lines.
    """
    start = lines.withColumn("rank", F.lit(0).cast("long"))
    ranked = checkpoint(start.join(_ranked(start, ["a", "b"]), ["rank", "a", "b"]).select(*_SUFFIX, "n_lines", "long", "next", "n"), "ranks")
    width = 1
    yield width, ranked
    texts = checkpoint(_still_open(ranked, width), "texts")
    while (until is None or width < until) and not texts.isEmpty():
        step = min(width, min_lines - width) if width < min_lines else width
        ahead = F.transform(F.filter("suffixes", lambda s: s["open"]), lambda s: F.struct(
            s["place"].alias("place"), s["rank"].alias("rank"), F.coalesce(F.get("suffixes", s["place"] + step)["rank"], F.lit(-1).cast("long")).alias("ahead")))
        pairs = texts.select("doc_id", "text_hash", "n_lines", F.inline(ahead))
        ranked = checkpoint(pairs.join(_ranked(pairs, ["ahead"]), ["rank", "ahead"]).select(*_SUFFIX, "n_lines", "next", "n"), "ranks")
        width += step
        yield width, ranked
        texts = checkpoint(_merged(texts, ranked, width), "texts")


def repeated_suffixes(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """Members of intervals of two suffixes or more: (doc_id, place, rank, single).

    ``rank`` names an interval whose members share ``min_lines`` lines; with ``long_words``
    also intervals of single lines of so many words, for which ``single`` is true.
    """
    found = []
    for width, ranked in rounds(checkpoint(line_ids(docs, long_words), "lines"), min_lines):
        tied = ranked.where((F.col("n") > 1) & (F.col("place") + width <= F.col("n_lines")))
        if width == min_lines:
            found.append(tied.select("doc_id", "place", F.col("next").alias("rank"), F.lit(False).alias("single")))
        if width == 1 and long_words is not None:
            found.append(tied.where("long").select("doc_id", "place", F.col("next").alias("rank"), F.lit(True).alias("single")))
    if not found:  # no line is repeated
        return docs.limit(0).select("doc_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("rank"), F.lit(False).alias("single"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def intervals(suffixes: DataFrame) -> DataFrame:
    """Intervals with the first of their suffixes: (rank, single, first, n)."""
    return (
        suffixes.groupBy("rank", "single").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"))


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """Where a later copy of ``min_lines`` repeated lines starts: (doc_id, places), and singles, the long lines that are later copies."""
    return settled(docs.sparkSession, lambda: (_copies(docs, min_lines, long_words),), "copies")[0]


def _copies(docs: DataFrame, min_lines: int, long_words: int | None) -> DataFrame:
    suffixes = repeated_suffixes(docs, min_lines, long_words)
    shared = checkpoint(intervals(suffixes), "intervals")
    # both sides are plain tables: Spark splits a hot interval over several tasks
    copies = suffixes.join(shared, ["rank", "single"]).where(F.struct("doc_id", "place") > F.col("first"))
    return copies.groupBy("doc_id").agg(  # never more than the lines of one text
        F.collect_set(F.when(~F.col("single"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("single"), F.col("place"))).alias("singles"))


def dedupe(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, plus n_lines and n_removed.

    Runs are compared over the whole corpus in the order of (doc_id, place in the text); the
    first copy stays. With ``long_words``, a repeated line of so many words or more is a run even
    by itself. Lines are equal if all their characters are. Blank lines belong to no
    run and stay. A null text stays null with no lines; an empty one stays empty. Documents
    without doc_id are returned unchanged and compared with nothing; rows that repeat a doc_id
    are one place, so none is a later copy of the other. Other columns pass through, also one
    named n_lines or n_removed, which is replaced. An empty table gives no rows.
    """
    found = later_copies(docs, min_lines, long_words)
    places = found.select(F.col("doc_id").alias("__doc"), F.col("places").alias("__places"), F.col("singles").alias("__singles"))
    joined = docs.join(places, docs["doc_id"] == places["__doc"], "left").drop("__doc")
    lines = F.split("text", "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    gone = F.flatten(F.transform("__places", lambda p: F.transform(F.sequence(F.lit(0), F.lit(min_lines - 1)), lambda k: F.get(filled, p + k))))
    gone = F.array_distinct(F.concat(gone, F.transform("__singles", lambda p: F.get(filled, p))))
    with_gone = computed(joined, "__gone", F.when(F.col("__places").isNotNull(), gone))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i))
    return with_gone.withColumns({
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long"),
        "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
    }).drop("__places", "__singles", "__gone")
