"""Inputs on which rows are easily lost."""
import pytest
from pyspark.sql import functions as F

from lexloom import session
from lexloom.operators import infer, ordered, search as S, tree as R
from lexloom.plans.index_flow import build_index
from lexloom.sources import files

PAGES = "document_id string, page_number int, text string, token_count int"
NODES = "document_id string, path array<bigint>, title string, start_index int, end_index int"


def test_vectors_of_two_lengths_are_both_searched(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None)], "query_id int, embedding array<float>")
    corpus = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.2, 1.0, 0.0]), (12, [0.0, 1.0]), (13, None)], "chunk_id int, embedding array<float>")
    got = {(r.query_id, r.chunk_id, r.rank) for r in S.semantic_topk(queries, corpus, 5).collect()}
    assert got == {(1, 10, 1), (1, 12, 2), (2, 11, 1)}
    assert S.semantic_topk(queries.limit(0), corpus, 5).columns == ["query_id", "chunk_id", "similarity", "rank"]


@pytest.mark.parametrize("descending", [False, True])
def test_null_order_and_keys_stay_with_buckets(spark, descending):
    rows = [("a", 1, 5), ("a", 700, 6), ("a", None, 7), (None, 3, 8), (None, 900, 9)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    sums = [ordered.running_sum(df, ["k"], ["o"], F.col("v"), "s", b, descending) for b in (None, F.floor(F.col("o") / 512))]
    assert sorted(map(str, sums[0].collect())) == sorted(map(str, sums[1].collect())) and sums[1].count() == 5
    kept = [ordered.carry(df, ["k"], ["o"], F.when(F.col("v") != 6, F.col("v")), "c", b, backward=descending) for b in (None, F.floor(F.col("o") / 512))]
    assert sorted(map(str, kept[0].collect())) == sorted(map(str, kept[1].collect()))


def test_large_node_starting_on_a_missing_page(spark):
    pages = spark.createDataFrame([("d", i, "t", 10) for i in range(1, 101) if i not in (5, 60)], PAGES)
    nodes = spark.createDataFrame([("d", [0], "A", 5, 60), ("d", [1], "B", 61, 500), ("d", [2], "C", 200, 400)], NODES)
    got = {r.title: r.n_tokens for r in R.large_nodes(nodes, pages, 10, 0).collect()}
    assert got == {"A": 540, "B": 400, "C": 0}


def test_splitting_goes_on_until_nothing_is_large(spark):
    pages = spark.createDataFrame([("d", i, "t", 10) for i in range(1, 321)], PAGES)
    nodes = spark.createDataFrame([("d", [0], "1-320", 1, 320)], NODES)

    def halves(big, _):
        """The node itself and a section for its second half."""
        mid = ((F.col("start_index") + F.col("end_index") + 1) / 2).cast("int")
        rows = F.array(F.struct(F.lit(0).alias("pos"), F.col("title").alias("title"), F.col("start_index").alias("at")),
                       F.struct(F.lit(1).alias("pos"), F.concat(mid.cast("string"), F.lit("+")).alias("title"), mid.alias("at")))
        return big.select("document_id", F.col("path").alias("parent_path"), F.explode(rows).alias("r")).select(
            "document_id", "parent_path", F.col("r.pos").cast("bigint").alias("pos"), F.col("r.pos").cast("string").alias("structure"),
            "r.title", F.col("r.at").alias("physical_index"), F.lit("yes").alias("appear_start"))
    out = R.split_large_nodes(nodes, pages, halves, max_pages=20, max_tokens=100)
    rows = out.collect()
    inner = {tuple(r.path[:-1]) for r in rows}  # cut nodes: their own end moved to their second section
    assert all(r.end_index - r.start_index <= 20 for r in rows if tuple(r.path) not in inner)
    assert max(len(r.path) for r in rows) > 4


def test_contents_row_on_a_page_without_text_stays(spark):
    toc = "Contents\n1 Alpha ..... 1\n2 Beta ..... 3\n3 Gamma ..... 4"
    texts = {1: toc, 2: "1 Alpha\ntext", 4: "2 Beta\nmore", 5: "3 Gamma\nend"}
    pages = spark.createDataFrame([("d", n, t, 10) for n, t in texts.items()], PAGES)
    titles = {r.title for r in build_index(pages).collect()}
    assert {"Alpha", "Beta", "Gamma"} <= titles


def test_pdf_without_extractor_gives_a_failed_row(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1.4")), ("b.txt", bytearray(b"text"))], "path string, content binary")
    got = {(r.path, r.page_number, r.text) for r in files.extract_pages(df).collect()}
    assert got == {("a.pdf", None, "no PDF extractor given"), ("b.txt", 1, "text")}


def test_long_headings_are_headings(spark):
    pages = spark.createDataFrame([("d", 1, "1 " + "x" * 250, 10)], PAGES)
    assert len(R.headings(pages).first().title) == 250


def test_outline_has_all_top_sections(spark):
    rows = [("d", [i], f"{i:04d}", f"T{i}", "s" * 300) for i in range(450)] + [("d", [0, 1], "9999", "below", "x")]
    nodes = spark.createDataFrame(rows, "document_id string, path array<bigint>, node_id string, title string, summary string")
    outline = R.outlines(nodes).select(F.from_json("outline", "array<struct<title:string,node_id:string,summary:string>>").alias("o")).first().o
    assert [e.title for e in outline] == [f"T{i}" for i in range(450)] and {len(e.summary) for e in outline} == {200}


def test_failing_provider_is_named_or_raises(spark):
    df = spark.createDataFrame([("a",), (" ",), (None,)], "t string")

    def broken():
        raise OSError("no network")
    got = df.select(infer.embed(F.col("t"), [("remote", broken), ("local", lambda: lambda ts: [[1.0, 2.0]] * len(ts))]).alias("e")).collect()
    assert [r.e and (r.e.provider, r.e.vector) for r in got] == [("local", [1.0, 2.0]), None, None]
    with pytest.raises(Exception, match="no embedding provider left"):
        df.select(infer.embed(F.col("t"), [("remote", broken)]).alias("e")).collect()


def test_cluster_without_shared_folder_is_refused(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster(), "x")
    assert session.is_local("local[4]") and not session.is_local("local-cluster[3,2,1024]")
