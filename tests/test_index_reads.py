"""The index build reads pages no oftener than it must, with the same rows."""
import random

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import tree as R
from lexloom.plans import index_flow


def test_right_rows_are_not_repaired(spark):
    v = spark.createDataFrame([("d", 0, "a b", 1, True), ("d", 1, "c", 2, None)], "document_id string, pos long, title string, physical_index int, is_correct boolean")
    p = spark.createDataFrame([("d", 1, "a b"), ("d", 2, "x")], "document_id string, page_number int, text string")
    bounds = spark.createDataFrame([("d", 1, 2)], "document_id string, first_page int, last_page int")
    assert R.repair_rows(v, p, bounds) is v
    wrong = v.withColumns({"physical_index": F.lit(2), "is_correct": F.lit(False)}).where("pos = 0")
    assert [(r.physical_index, r.is_correct) for r in R.repair_rows(wrong, p, bounds).collect()] == [(1, True)]


def test_headings_are_read_from_the_pages_once(spark, monkeypatch):
    names = []
    real = index_flow.checkpoint
    monkeypatch.setattr(index_flow, "checkpoint", lambda df, name="step": names.append(name) or real(df, name))
    pages = spark.createDataFrame([("d", i, f"{i} Title {i}\nsome text {i}", 5) for i in range(1, 6)], "document_id string, page_number int, text string, token_count long")
    got = sorted((r.node_id, r.title, r.text) for r in index_flow.build_index(pages).collect())
    page = lambda i: f"{i} Title {i}\nsome text {i}\n" if i < 6 else ""
    assert got == [(f"{i - 1:04d}", f"Title {i}", page(i) + page(i + 1)) for i in range(1, 6)]  # a number before the title, so none opens its page
    assert "fresh" in names


def test_heads_of_pages_tell_what_whole_pages_tell(spark):
    rng = random.Random(2)
    pieces = ["Tax", " ", "\u00a0", "--", "\n", "Rate_9", "é", "zone", ". ", "\U0001f600"]
    rows = [("".join(rng.choices(pieces, k=rng.randint(0, 4))), "".join(rng.choices(pieces, k=rng.choice([3, 200, 400])))) for _ in range(300)]
    rows += [(p[:n], p) for _, p in rows[:60] for n in (5, 600)] + [(None, "a"), ("a", None), ("", ""), ("end", "-" * 600 + "end"), ("x" * 600, "x" * 700)]
    df = spark.createDataFrame(rows, "t string, p string")
    t, p = T.normalize_match(F.col("t")), T.normalize_match(F.col("p"))
    out = df.select(R.title_on_page(F.col("t"), F.col("p")).alias("a"), p.contains(t).alias("b"), R.starts_page(F.col("t"), F.col("p")).alias("c"), F.when(p.startswith(t), "yes").otherwise("no").alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in out) and {r.c for r in out} == {"yes", "no"}
