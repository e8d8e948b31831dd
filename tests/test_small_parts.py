"""Small operators that no catalogue query calls."""
from pyspark.sql import functions as F

from lexloom.functions import vectors as V
from lexloom.operators import context, evaluation as E, infer, prefilter, tables


def test_display_rows_and_document_attribution(spark):
    hits = spark.createDataFrame([("q", 1, "d", "0001", "x" * 600), ("q", 2, "e", "0001", "short")], "query_id string, rank int, document_id string, node_id string, content string")
    shown = {r["index"]: r.content for r in context.display_rows(hits).collect()}
    assert shown == {1: "x" * 500, 2: "short"}
    nodes = spark.createDataFrame([("d", "0001", "d.pdf"), ("e", "0001", "e.pdf")], "document_id string, node_id string, file_name string")
    assert {(r.document_id, r.file_name) for r in context.attribute_documents(hits, nodes).collect()} == {("d", "d.pdf"), ("e", "e.pdf")}


def test_mean_over_successful_tries(spark):
    rows = spark.createDataFrame([(10.0, True), (30.0, True), (99.0, False)], "ms double, ok boolean")
    assert tuple(E.retry_average(rows, F.col("ok"), "ms").first()) == (20.0, 2)


def test_find_or_create_keeps_missing_rows(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    have = spark.createDataFrame([(1,), (1,)], "id int")
    assert sorted(r.v for r in tables.find_or_create(wanted, have, ["id"]).collect()) == ["b", "c"]


def test_missing_core_documents_are_added_once(spark):
    chosen = spark.createDataFrame([("q", "a", 1)], "query_id string, document_id string, rank int")
    core = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, document_id string")
    assert {(r.document_id, r.rank) for r in prefilter.add_missing_core(chosen, core).collect()} == {("a", 1), ("b", None)}


def test_vectors_from_json(spark):
    df = spark.createDataFrame([("[1, 2.5]",), (None,)], "t string")
    assert [r[0] for r in df.select(V.from_json_vector(F.col("t"))).collect()] == [[1.0, 2.5], None]


def test_questions_from_the_first_chunks(spark):
    chunks = spark.createDataFrame([("d", i, f"text {i}") for i in range(4)], "document_id string, chunk_index int, content string")
    got = infer.synthetic_questions(chunks, "document_id", "chunk_index", lambda: lambda ps: [f'["about {p}?"]' for p in ps], "{content}", first=2)
    assert sorted(r.question for r in got.collect()) == ["about text 0?", "about text 1?"]


def test_hashed_vectors_are_the_same_everywhere(spark):
    df = spark.createDataFrame([("Article 5",), ("article 5",)], "t string").repartition(2)
    got = df.select(infer.embed(F.col("t")).alias("e")).collect()
    assert got[0].e.vector == got[1].e.vector and got[0].e.provider == infer.HASHED
