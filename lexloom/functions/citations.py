"""Citation marks ``[n]`` in answers: extract, filter, renumber, validate, score."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexloom import vocab
from lexloom.functions import text as T

_FACT = "(?i)" + T.ascii_boundaries(vocab.FACT_PATTERN)


def marks(answer: Column) -> Column:
    """Every citation number in order, repeats included."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("bigint"))


def cited_numbers(answer: Column) -> Column:
    """Distinct citation numbers by first appearance."""
    return F.array_distinct(marks(answer))


def cited_sources(answer: Column, sources: Column) -> Column:
    """The entries of a source array whose 1-based place is cited."""
    used = cited_numbers(answer)
    return F.filter(sources, lambda s, i: F.array_contains(used, (i + 1).cast("bigint")))


def _renumber(answer: Column, new_number) -> Column:
    """Each mark rewritten through ``new_number(piece, n)``; a null or 0 result keeps the mark.

    The text is cut at the marks first, so a new number can never be rewritten again.
    """
    cut = F.split(F.regexp_replace(answer, r"(\[\d+\])", f"{T.MARK}$1{T.MARK}"), T.MARK, -1)

    def piece(p, i):
        n = F.regexp_extract(p, r"^\[(\d+)\]$", 1)
        new = new_number(p, F.nullif(n, F.lit("")).try_cast("bigint"))
        return F.when((i % 2 == 1) & (new > 0), F.concat(F.lit("["), new.cast("string"), F.lit("]"))).otherwise(p)

    return F.array_join(F.transform(cut, piece), "")


def renumber_by_source(answer: Column, n_sources: Column) -> Column:
    """Cited sources numbered 1.. in source order; unknown numbers stay."""
    kept = F.array_sort(F.filter(cited_numbers(answer), lambda n: (n >= 1) & (n <= n_sources)))
    return _renumber(answer, lambda p, n: F.array_position(kept, n))


def renumber_by_appearance(answer: Column) -> Column:
    """Citations numbered 1.. by first appearance. A mark with leading zeros stays."""
    seen = cited_numbers(answer)
    return _renumber(answer, lambda p, n: F.when(p == F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.array_position(seen, n)))


def sources_by_appearance(answer: Column, sources: Column) -> Column:
    """Cited sources of an array of structs with field ``index``, renumbered and re-sorted."""
    seen = cited_numbers(answer)
    kept = F.transform(
        F.filter(sources, lambda s: F.array_contains(seen, s["index"].cast("bigint"))),
        lambda s: s.withField("index", F.array_position(seen, s["index"].cast("bigint"))),
    )
    return F.array_sort(kept, lambda a, b: (a["index"] - b["index"]).cast("int"))


def grounding(n_cited: Column) -> Column:
    return F.when(n_cited > 0, F.lit("grounded")).otherwise(F.lit("ungrounded"))


def validate(answer: Column, n_sources: Column) -> Column:
    """Struct is_valid, issues, citation_count, fact_count, coverage, clustered, invalid."""
    return T.let(marks(answer), lambda m: _validate(answer, n_sources, m))


def _validate(answer: Column, n_sources: Column, all_marks: Column) -> Column:
    used = F.array_distinct(all_marks)
    sentences = F.filter(F.split(answer, "[.!?]+", -1), lambda s: T.trim_ws(s) != "")
    found = F.struct(
        F.filter(used, lambda n: (n > n_sources) | (n < 1)).alias("invalid"),
        F.filter(sentences, lambda s: s.rlike(_FACT)).alias("facts"),
        F.exists(F.split(answer, "\n\n+", -1), lambda p: p.rlike(r"(\[\d+\]){2,}[\s\u00a0]*\z")).alias("clustered"),
    )

    def with_issues(f):
        # the transition test sees the untrimmed sentence, so it only spares text starting the answer
        bare = F.filter(f["facts"], lambda s: ~s.contains("[") & ~s.rlike("(?i)" + vocab.TRANSITION_PATTERN))
        issues = F.concat(
            F.transform(f["invalid"], lambda n: F.concat(F.lit("Invalid citation ["), n.cast("string"), F.lit("] - only "), n_sources.cast("string"), F.lit(" sources available"))),
            F.when(f["clustered"], F.array(F.lit("Citations clustered at paragraph end (should be inline)"))).otherwise(F.array().cast("array<string>")),
            F.transform(bare, lambda s: F.concat(F.lit('Potentially uncited fact: "'), F.substring(T.trim_ws(s), 1, 50), F.lit('..."'))),
        )
        return F.struct(f["invalid"].alias("invalid"), f["clustered"].alias("clustered"), F.greatest(F.size(f["facts"]), F.lit(1)).alias("fact_count"), issues.alias("issues"))

    def result(g):
        coverage = F.least(F.size(all_marks) / g["fact_count"], F.lit(1.0))
        return F.struct(
            ((F.size(g["issues"]) == 0) & (coverage >= 0.5)).alias("is_valid"), g["issues"].alias("issues"),
            F.size(all_marks).alias("citation_count"), g["fact_count"].alias("fact_count"), coverage.alias("coverage"),
            g["clustered"].alias("clustered"), g["invalid"].alias("invalid"),
        )

    return T.let(found, lambda f: T.let(with_issues(f), result))


def _per_topic(low: Column, build) -> list[Column]:
    """``build(topic row)`` where the lower-cased query is about the topic, an empty array elsewhere."""
    empty = F.array().cast("array<string>")
    return [F.when(T.contains_any(low, row[1]), build(row)).otherwise(empty) for row in vocab.KEY_FIGURES]


def _strings(cols: list[Column]) -> Column:
    return F.filter(F.array(*cols), lambda s: s.isNotNull())


def key_figures(query: Column, answer: Column) -> Column:
    """Struct present, missing, topics: figures an answer on the query's topics should give."""
    def figures(low):
        query, answer = low["query"], low["answer"]
        present = F.concat(*_per_topic(query, lambda r: _strings([F.when(answer.contains(f.lower()), F.lit(f"{r[0]}: {f}")) for f in r[2]])))
        missing = F.concat(*_per_topic(query, lambda r: _strings([F.when(~answer.contains(f.lower()), F.lit(f"{r[0]}: {f} ({r[3]})")) for f in r[2]])))
        topics = F.concat(*_per_topic(query, lambda r: F.array(F.lit(r[0]))))
        return F.struct(present.alias("present"), missing.alias("missing"), topics.alias("topics"))
    return T.let(F.struct(F.lower(query).alias("query"), F.lower(answer).alias("answer")), figures)


def key_figure_lines(query: Column) -> Column:
    """``- figures: description`` line per topic of the query, one text; empty without topics."""
    return T.let(F.lower(query), lambda low: F.array_join(F.concat(*_per_topic(low, lambda r: F.array(F.lit(f"- {' / '.join(r[2])}: {r[3]}")))), "\n"))


def quality_score(query: Column, answer: Column, n_sources: Column) -> Column:
    """Struct score (0-100), citation_quality (40), key_figures (30), completeness (30), feedback."""
    both = F.struct(validate(answer, n_sources).alias("checked"), key_figures(query, answer).alias("figures"))
    return T.let(both, lambda b: _score(answer, b["checked"], b["figures"]))


def _score(answer: Column, checked: Column, figures: Column) -> Column:
    citation = F.lit(40) - F.when(checked["clustered"], 15).otherwise(0) \
        - F.when(F.size(checked["invalid"]) > 0, 10).otherwise(0) - F.when(checked["coverage"] < 0.5, 15).otherwise(0)
    n_present, n_missing = F.size(figures["present"]), F.size(figures["missing"])
    ratio = F.try_divide(n_present, n_present + n_missing)
    figure_points = F.when(F.size(figures["topics"]) > 0, F.floor(ratio * 30 + 0.5)).otherwise(F.lit(30)).cast("int")
    words = T.split_count(answer)
    flat = ~answer.contains("\n") & (words > 100)
    complete = F.lit(30) - F.when(words < 50, 15).otherwise(0) - F.when(flat, 5).otherwise(0)
    shown = F.transform(F.slice(figures["missing"], 1, 3), lambda m: F.try_element_at(F.split(m, ":"), F.lit(2)))
    feedback = _strings([
        F.when(checked["clustered"], F.lit("Citations should be inline, not grouped at paragraph end")),
        F.when(F.size(checked["invalid"]) > 0, F.lit("Some citations reference non-existent sources")),
        F.when(checked["coverage"] < 0.5, F.lit("Many factual claims lack citations")),
        F.when(n_missing > 0, F.concat(F.lit("Missing key figures: "), F.array_join(shown, ", "))),
        F.when(words < 50, F.lit("Response may be too brief")),
        F.when(flat, F.lit("Consider adding paragraph breaks for readability")),
    ])
    return F.struct(
        (citation + figure_points + complete).alias("score"), citation.alias("citation_quality"),
        figure_points.alias("key_figures"), complete.alias("completeness"), feedback.alias("feedback"),
    )
