"""Evaluation question sets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUESTION = ("id STRING, query STRING, category STRING, difficulty STRING, expected_keywords ARRAY<STRING>, "
            "expected_articles ARRAY<STRING>, curation STRUCT<status:STRING>")
QA_PAIR = ("id STRING, question STRING, answer STRING, chunk_span INT, source_chunk_ids ARRAY<STRING>, source_documents ARRAY<STRING>, "
           "source_content STRING, topic STRING, complexity STRING")


def load_questions(spark: SparkSession, path: str, field: str = "questions", schema: str = QUESTION) -> DataFrame:
    """One row per question of JSON files holding one list each."""
    raw = spark.read.schema(f"`{field}` ARRAY<STRUCT<{_struct(schema)}>>").json(path, multiLine=True)
    return raw.select(F.inline(field))


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def select_questions(questions: DataFrame, ids: list[str] | None = None, category: str | None = None, difficulty: str | None = None,
                     limit: int | None = None, order: Column | None = None) -> DataFrame:
    """Active questions; an id list overrides every other filter; negative, ambiguous and
    vague ones are left out; the first ``limit`` by ``order`` (a feature of the runner)."""
    out = questions.where(F.col("curation.status") == "active")
    if ids:
        return out.where(F.col("id").isin(*ids))
    if category:
        out = out.where(F.col("category") == category)
    if difficulty:
        out = out.where(F.col("difficulty") == difficulty)
    out = out.where(~F.col("category").isin("negative", "ambiguous", "vague"))
    return out.orderBy(order if order is not None else F.col("id")).limit(limit) if limit is not None else out
