"""Registry of catalogue queries and the tables they derive from the given ones."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.session import spread

ROWS_PER_TASK = 200_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a catalogue query, with its SQL counterpart when there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each."""
    return spread(table(spark, sf_dir, name))


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Narrow columns whose rows take much work each, dealt out by number.

    A file may have few row groups, and each is read by one task however many splits it has.
    """
    rows = table(spark, sf_dir, name).select(*columns)
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK)))


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def pick(forms: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in forms]), (number % len(forms) + 1).cast("int"))


# Question and answer texts are made per order, so their number grows with the table.
QUESTION_FORMS = [
    "What is the corproate tax rate under Article {n}?",
    "How do I register for CT with the FTA before the deadline in chapter {n}?",
    "Explain the GAAR and anti-abuse rule of Article {n} (2) and Section 4.{n}",
    "Define permanent establishment",
    "  penaltiy for late filing in FY   20{n} ",
    "Does Federal Decree-Law No. {n} apply to free zone entities with qualifying income?",
    "write me a python script for article {n}",
    "Is VAT charged at {n} percent?",
    "weather in dubai today",
    "What about this?",
    "tell me more about that",
    "Compare transfer pricing documentation, related party disclosures and arm's length evidence under Article {n} with the rules for small business relief and tax group members in several emirates",
    "threshold for taxable income and exemtion of dividend",
    "quote Article {n} verbatim",
    "Cabinet Decision No. {n} and Ministerial Decision {n} on interest deduction limitation",
    "recipe for pancakes",
    "When should a resident person file the tax return for period {n}?",
    "small business relief revenue limit",
    "tax group ownership consolidation loss carry forward offset",
    "what does chapter {n} say on the assesment of withholding tax and p&l items",
    "Suppose a holding has {n} subsidiaries, what are the consequences for the participation exemption when one subsidiary is sold in the tax year and another one is moved out of a qualifying free zone to the mainland",
    "elaborate",
    "registered entities and compiance violaton penalities",
    "thanks, and the 5% tax for Article {n}?",
]
ANSWER_FORMS = [
    "The standard rate is 9% above AED 375,000 [{a}]. Below it the rate is 0% [{b}]. See Article {n} [{a}].",
    "Article {n} applies from 2023. Returns are due within 9 months [{b}][{a}]\n\nA second paragraph on penalties ends here.[1][2] ",
    "No figures are given here.",
    "Registration takes 3 months [{a}], additionally the group needs 95% ownership. Losses offset up to 75% [{b}]! Was 30% of EBITDA or AED 12 million used? [12] [1]",
    "for example 5 years apply. Sorry, I could not find the rest [99] and [0].",
    "Small business relief covers revenue up to AED 3 million [{b}].\n\nSection {n} lists the conditions [{a}] [{b}].\n\n\nFurthermore 30 days remain [007].",
    "plain text that goes on and on " + "with many more words about income and relief " * 15 + "[{a}]",
    "",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, owner, question: one question per order."""
    o = dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    text = F.replace(pick(QUESTION_FORMS, F.col("o_orderkey")), F.lit("{n}"), (F.col("o_custkey") % 97 + 1).cast("string"))
    return o.select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("owner"), text.alias("question"))


QUESTIONS_SQL = f"""questions AS (
  SELECT o_orderkey AS question_id, o_custkey AS owner,
         replace(list_extract({sql_list(QUESTION_FORMS)}, (o_orderkey % {len(QUESTION_FORMS)} + 1)::INT),
                 '{{n}}', (o_custkey % 97 + 1)::VARCHAR) AS question
  FROM orders)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, answer, n_sources: one answer per order."""
    o = dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("question_id"),
        pick(ANSWER_FORMS, F.col("o_custkey")).alias("form"),
        (F.col("o_orderkey") % 7 + 1).cast("string").alias("a"),
        (F.col("o_custkey") % 5 + 1).cast("string").alias("b"),
        (F.col("o_orderkey") % 89 + 1).cast("string").alias("n"),
        (F.col("o_orderkey") % 6).alias("n_sources"),
        F.replace(pick(QUESTION_FORMS, F.col("o_orderkey")), F.lit("{n}"), (F.col("o_custkey") % 97 + 1).cast("string")).alias("question"),
    )
    text = F.col("form")
    for name in "abn":
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
    return o.select("question_id", "question", text.alias("answer"), "n_sources")


ANSWERS_SQL = f"""answers AS (
  SELECT question_id, question, n_sources,
         replace(replace(replace(form, '{{a}}', a), '{{b}}', b), '{{n}}', n) AS answer
  FROM (SELECT o_orderkey AS question_id,
               list_extract({sql_list(ANSWER_FORMS)}, (o_custkey % {len(ANSWER_FORMS)} + 1)::INT) AS form,
               (o_orderkey % 7 + 1)::VARCHAR AS a, (o_custkey % 5 + 1)::VARCHAR AS b,
               (o_orderkey % 89 + 1)::VARCHAR AS n, o_orderkey % 6 AS n_sources,
               replace(list_extract({sql_list(QUESTION_FORMS)}, (o_orderkey % {len(QUESTION_FORMS)} + 1)::INT),
                       '{{n}}', (o_custkey % 97 + 1)::VARCHAR) AS question
        FROM orders))"""

# regex classes as written for the SQL side
WS_SQL = r"[\s\x{00a0}]+"


def sql_trim(e: str) -> str:
    return f"regexp_replace({e}, '^{WS_SQL}|{WS_SQL}$', '', 'g')"


def sql_tokens(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}]+')"
