"""The scalar rules and the splitter for SQL users."""
from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexloom import vocab


def register(spark: SparkSession) -> None:
    """Temporary functions: cosine_similarity, rrf_term, estimate_tokens, strip_html, and the table functions split_text and split_documents."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(v ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN sqrt(aggregate(transform(v, x -> x * x), 0D, (s, x) -> s + x))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN CASE WHEN size(a) = size(b) AND size(a) > 0
            THEN try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), vector_norm(a) * vector_norm(b)) ELSE 0D END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION rrf_term(item_rank BIGINT, k INT, weight DOUBLE) RETURNS DOUBLE
        RETURN coalesce(weight / (k + item_rank), 0D)""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS BIGINT RETURN ceil(length(t) / 4)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION strip_html(h STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' '), '[\\s\\u00a0]+', ' '))")
    spark.udtf.register("split_text", _splitter())
    spark.udtf.register("split_documents", _table_splitter())


def _splitter():
    separators = vocab.SPLIT_SEPARATORS

    @udtf(returnType="pos int, content string")
    class SplitText:
        """``LATERAL split_text(text, size, overlap)``: the chunks of one text."""

        def eval(self, text: str, size: int, overlap: int):
            from lexloom.operators.chunking import split_recursive
            if text:
                yield from enumerate(split_recursive(text, size, overlap, separators))

    return SplitText


def _table_splitter():
    separators = vocab.SPLIT_SEPARATORS

    @udtf
    class SplitDocuments:
        """``split_documents(TABLE(SELECT key, text …) PARTITION BY (key), size, overlap)``: chunks with the key of their row.

        The columns of the result follow from the table: its columns but the last, then pos and content.
        """

        @staticmethod
        def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
            columns = rows.dataType.fields
            if len(columns) < 2 or columns[-1].dataType != StringType():
                raise ValueError("the table needs key columns and a text column at the end")
            schema = StructType([StructField(c.name, c.dataType) for c in columns[:-1]]).add("pos", IntegerType()).add("content", StringType())
            return AnalyzeResult(schema=schema)

        def eval(self, row: Row, size: int, overlap: int):
            from lexloom.operators.chunking import split_recursive
            *keys, text = row
            for pos, content in enumerate(split_recursive(text, size, overlap, separators) if text else []):
                yield (*keys, pos, content)

    return SplitDocuments
