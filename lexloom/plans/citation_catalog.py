"""Catalogue: citations and answer quality over one answer per order."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import vocab
from lexloom.functions import citations as C
from lexloom.operators.rows import computed
from lexloom.plans.common import ANSWERS_SQL, answers, q, query, sql_list, sql_trim

_MARKS = r"list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda n: n::BIGINT)"
_NUMBERED = f"m AS (SELECT *, {_MARKS} AS marks FROM answers), u AS (SELECT *, list_filter(marks, lambda x, i: list_position(marks, x) = i) AS used FROM m)"


@query("citations_used", f"""WITH {ANSWERS_SQL}, {_NUMBERED}
SELECT question_id, array_to_string(used, ',') AS used, array_to_string(list_filter(range(1, n_sources + 1), lambda s: list_contains(used, s)), ',') AS kept,
  CASE WHEN len(list_filter(range(1, n_sources + 1), lambda s: list_contains(used, s))) > 0 THEN 'grounded' ELSE 'ungrounded' END AS grounding FROM u""")
def citations_used(spark, sf):
    src = F.when(F.col("n_sources") > 0, F.sequence(F.lit(1), F.col("n_sources"))).otherwise(F.array().cast("array<bigint>"))
    d = answers(spark, sf).withColumn("kept", C.cited_sources(F.col("answer"), src))
    return d.select("question_id", F.array_join(C.cited_numbers(F.col("answer")).cast("array<string>"), ",").alias("used"),
                    F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), C.grounding(F.size("kept")).alias("grounding"))


# every number an answer here can hold is replaced in two rounds, through a marked form
def _renumber_sql(target: str) -> str:
    return f"""WITH {ANSWERS_SQL}, {_NUMBERED}, t AS (SELECT *, {target} AS ranked FROM u),
pieces AS (SELECT question_id, ranked, regexp_split_to_array(regexp_replace(answer, '(\\[\\d+\\])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM t)
SELECT question_id, array_to_string(list_transform(p, lambda x: CASE
  WHEN regexp_full_match(x, '\\[\\d+\\]') AND COND THEN '[' || list_position(ranked, x[2:-2]::BIGINT) || ']' ELSE x END), '') AS text FROM pieces"""


@query("citations_renumber_source", _renumber_sql("list_sort(list_filter(used, lambda x: x >= 1 AND x <= n_sources))").replace("COND", "list_contains(ranked, x[2:-2]::BIGINT)"))
def citations_renumber_source(spark, sf):
    return answers(spark, sf).select("question_id", C.renumber_by_source(F.col("answer"), F.col("n_sources")).alias("text"))


@query("citations_renumber_first", _renumber_sql("used").replace("COND", "x = '[' || x[2:-2]::BIGINT || ']'"))
def citations_renumber_first(spark, sf):
    return answers(spark, sf).select("question_id", C.renumber_by_appearance(F.col("answer")).alias("text"))


_FACT = q("(?i)" + vocab.FACT_PATTERN)
_TRIMMED = sql_trim("s")
_VALID = f"""{_NUMBERED}, v AS (SELECT *, list_filter(used, lambda x: x > n_sources OR x < 1) AS invalid,
  list_filter(regexp_split_to_array(answer, '[.!?]+'), lambda s: {_TRIMMED} <> '' AND regexp_matches(s, {_FACT})) AS facts,
  len(list_filter(regexp_split_to_array(answer, '\\n\\n+'), lambda p: regexp_matches(p, '(\\[\\d+\\]){{2,}}[\\s\\x{{00a0}}]*$'))) > 0 AS clustered FROM u),
w AS (SELECT *, greatest(len(facts), 1) AS fact_count, least(len(marks) / greatest(len(facts), 1), 1.0)::DOUBLE AS coverage,
  list_filter(facts, lambda s: NOT contains(s, '[') AND NOT regexp_matches(s, {q('(?i)' + vocab.TRANSITION_PATTERN)})) AS bare FROM v),
x AS (SELECT *, list_concat(list_concat(list_transform(invalid, lambda n: 'Invalid citation [' || n || '] - only ' || n_sources || ' sources available'),
  CASE WHEN clustered THEN ['Citations clustered at paragraph end (should be inline)'] ELSE [] END),
  list_transform(bare, lambda s: 'Potentially uncited fact: "' || substring({_TRIMMED}, 1, 50) || '..."')) AS issues FROM w)"""


@query("citations_validate", f"""WITH {ANSWERS_SQL}, {_VALID}
SELECT question_id, len(issues) = 0 AND coverage >= 0.5 AS is_valid, array_to_string(issues, ' ; ') AS issues, len(marks)::BIGINT AS citation_count,
  fact_count::BIGINT AS fact_count, round(coverage, 6) AS coverage, clustered, array_to_string(invalid, ',') AS invalid FROM x""")
def citations_validate(spark, sf):
    d = answers(spark, sf).withColumn("v", C.validate(F.col("answer"), F.col("n_sources")))
    return d.select("question_id", "v.is_valid", F.array_join("v.issues", " ; ").alias("issues"), F.col("v.citation_count").cast("bigint").alias("citation_count"),
                    F.col("v.fact_count").cast("bigint").alias("fact_count"), F.round("v.coverage", 6).alias("coverage"), "v.clustered",
                    F.array_join(F.col("v.invalid").cast("array<string>"), ",").alias("invalid"))


def _topic(words):
    return "(" + " OR ".join(f"contains(lower(question), {q(w)})" for w in words) + ")"


def _fig(kind):
    parts = []
    for name, words, figures, text in vocab.KEY_FIGURES:
        for f in figures:
            hit = f"contains(lower(answer), {q(f.lower())})"
            parts.append(f"CASE WHEN {_topic(words)} AND {hit} THEN {q(f'{name}: {f}')} END" if kind == "present"
                         else f"CASE WHEN {_topic(words)} AND NOT {hit} THEN {q(f'{name}: {f} ({text})')} END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN {_topic(w)} THEN {q(n)} END" for n, w, _, _ in vocab.KEY_FIGURES) + "], lambda x: x IS NOT NULL)"
_LINES = "list_filter([" + ", ".join(f"CASE WHEN {_topic(w)} THEN {q('- ' + ' / '.join(f) + ': ' + t)} END" for _, w, f, t in vocab.KEY_FIGURES) + "], lambda x: x IS NOT NULL)"


@query("key_figures", f"""WITH {ANSWERS_SQL} SELECT question_id, array_to_string({_fig('present')}, ' ; ') AS present, array_to_string({_fig('missing')}, ' ; ') AS missing,
  array_to_string({_TOPICS}, ',') AS topics, array_to_string({_LINES}, chr(10)) AS lines FROM answers""")
def key_figures(spark, sf):
    d = answers(spark, sf).withColumn("k", C.key_figures(F.col("question"), F.col("answer")))
    return d.select("question_id", F.array_join("k.present", " ; ").alias("present"), F.array_join("k.missing", " ; ").alias("missing"),
                    F.array_join("k.topics", ",").alias("topics"), C.key_figure_lines(F.col("question")).alias("lines"))


@query("quality_score", f"""WITH {ANSWERS_SQL}, {_VALID}, k AS (SELECT *, {_fig('present')} AS present, {_fig('missing')} AS missing, {_TOPICS} AS topics,
  len(regexp_split_to_array(answer, '[\\s\\x{{00a0}}]+')) AS words FROM x),
s AS (SELECT question_id, 40 - CASE WHEN clustered THEN 15 ELSE 0 END - CASE WHEN len(invalid) > 0 THEN 10 ELSE 0 END - CASE WHEN coverage < 0.5 THEN 15 ELSE 0 END AS cq,
  CASE WHEN len(topics) > 0 THEN floor(len(present) / (len(present) + len(missing)) * 30 + 0.5) ELSE 30 END AS kf,
  30 - CASE WHEN words < 50 THEN 15 ELSE 0 END - CASE WHEN NOT contains(answer, chr(10)) AND words > 100 THEN 5 ELSE 0 END AS co FROM k)
SELECT question_id, (cq + kf + co)::BIGINT AS score, cq::BIGINT AS citation_quality, kf::BIGINT AS key_figures, co::BIGINT AS completeness FROM s""")
def quality_score(spark, sf):
    d = computed(answers(spark, sf), "s", C.quality_score(F.col("question"), F.col("answer"), F.col("n_sources")))
    return d.select("question_id", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("score", "citation_quality", "key_figures", "completeness")])
