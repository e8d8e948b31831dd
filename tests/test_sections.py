"""Deep trees, range numbering, and section selection from page counts."""
import random

from pyspark.sql import functions as F

from lexloom.operators import ordered, tree as R


def test_paths_of_a_deep_tree(spark):
    """A chain of 45 levels, a broken branch and two documents."""
    rows = [("d", i, i - 1 if i else None) for i in range(45)] + [("d", 100, 44), ("d", 101, 3), ("d", 200, 999), ("d", 201, 200), ("e", 7, None)]
    got = {(r.document_id, r.pos): r.path for r in R.with_paths(spark.createDataFrame(rows, "document_id string, pos bigint, parent_pos bigint")).collect()}
    want = {("d", i): list(range(i + 1)) for i in range(45)} | {("d", 100): [*range(45), 100], ("d", 101): [0, 1, 2, 3, 101], ("e", 7): [7]}
    assert got == want


def test_numbers_by_range(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(9)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.k, r.x): r.n for r in ordered.row_index_by_range(df, ["k"], ["x"], "n", 1).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = {}
    for k in {k for k, _ in rows}:
        want |= {(k, x): i + 1 for i, x in enumerate(sorted(x for q, x in rows if q == k))}
    assert got == want


def _tree(spark, seed=2):
    rng = random.Random(seed)
    words = ["tax", "relief", "zone", "group", "loss", "late", "filing", "rate"]
    pages = [(d, p, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for d in ("a", "b", "c") for p in range(1, 13) if p != 5] + [("c", 13, None)]
    nodes = [(d, [r] if k is None else [r, k], f"{rng.choice(words)} part {r} {k}", 1 + 3 * r if k is None else 1 + 3 * r + k, 3 * r + 4 if k is None else 1 + 3 * r + k)
             for d in ("a", "b", "c") for r in range(4) for k in (None, 0, 1)] + [("a", [9], "empty relief", 8, 7)]
    p = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    n = R.number_nodes(spark.createDataFrame(nodes, "document_id string, path array<bigint>, title string, start_index int, end_index int"))
    qs = spark.createDataFrame([(i, " ".join(rng.choices(words + ["other"], k=4))) for i in range(12)] + [(50, "nothing here"), (51, None)], "query_id int, question string")
    return n, p, qs


def test_sections_from_page_counts_equal_those_from_texts(spark):
    n, p, qs = _tree(spark)
    want = R.select_by_terms(qs, R.node_texts(n, p), 4)
    got = R.select_sections(qs, n, p, 4)
    rows = lambda df: {(r.query_id, r.document_id, r.node_id, r.pos, r.score, r.confidence) for r in df.collect()}
    assert rows(got) == rows(want) and want.count() > 20
    allowed = spark.createDataFrame([(q, d) for q in range(12) for d in ("a", "b", "c") if (q + ord(d)) % 2], "query_id int, document_id string")
    assert rows(R.select_sections(qs, n, p, 4, allowed)) == rows(R.select_by_terms(qs, R.node_texts(n, p), 4, allowed))


def test_documents_in_order_of_arrival_and_reranked(spark):
    n, p, qs = _tree(spark, 3)
    selected = R.select_sections(qs, n, p, 3)
    arrival = spark.createDataFrame([(q, d, i + 1) for q in range(12) for i, d in enumerate(("c", "a", "b"))], "query_id int, document_id string, document_pos int")
    got = R.retrieve_from_trees(selected, n, p, 2, 4, arrival).collect()
    for q in range(12):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        order = ["cab".index(r.document_id) for r in mine]
        assert order == sorted(order) and len(mine) <= 4 and all(order.count(x) <= 2 for x in order)
    texts = {(r.document_id, r.node_id): r.text for r in R.node_texts(n, p).collect()}
    assert all(r.text == texts[r.document_id, r.node_id] for r in got)
    again = R.retrieve_from_trees(selected, n, p, 3, 4, arrival, qs).collect()
    words = {r.query_id: r.question for r in qs.collect()}

    def score(r):
        body = f"{r.title} {r.section_path} {r.text}".lower().split()
        return -round(sum(body.count(w) for w in words[r.query_id].split()) / len(f"{r.title} {r.section_path} {r.text}") ** 0.5, 9)
    for q in range(12):
        mine = [score(r) for r in sorted((r for r in again if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) < 4 or mine == sorted(mine)
    assert R.retrieve_from_trees(selected.limit(0), n, p).count() == 0


def test_percentiles_of_a_skewed_key(spark):
    """One key with nearly all rows, whose values lie in a hair's breadth but for one."""
    rng = random.Random(6)
    rows = [("hot", 1 + rng.random() * 1e-9) for _ in range(4000)] + [("hot", 1e12), (None, 3.0), (None, None), ("one", -5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.k: (r.a, r.b) for r in ordered.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    ranged = ordered.running_sum_by_range(df.where("v IS NOT NULL"), ["k"], ["v"], F.lit(1), "n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    values = sorted(v for k, v in rows if k == "hot")
    assert got["hot"] == (values[2000], values[3800]) and got[None] == (3.0, 3.0) and got["one"] == (-5.0, -5.0)
    assert {r.n for r in ranged.where("k = 'hot'").collect()} == set(range(1, 4002))
