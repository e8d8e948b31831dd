"""Operators against plain windows and brute force on small fixtures."""
import datetime as dt
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from lexloom.functions import vectors as V
from lexloom.operators import chunking, context, conversation, evaluation as E, infer, ordered, prefilter as P, rerank, search as S, tables, tree as R
from lexloom.sources import files, questions, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ ordered operators

@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    # key 0 holds most rows; positions have gaps; values are often null
    rows = [(0 if i % 3 else i % 7, i * 3 + rng.randint(0, 2), rng.choice([None, rng.randint(0, 9)])) for i in range(400)]
    return spark.createDataFrame(rows, "k int, p bigint, v int").cache()


def same(a, b, cols):
    def rows(df):
        return sorted(map(str, df.select(*cols).collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("width", [1, 10, 5000])
def test_bucketed_equals_plain_window(series, width):
    b = F.floor(F.col("p") / width)
    for descending in (False, True):
        for value in (F.col("v"), F.lit(1)):
            args = (["k"], ["p"], value, "x")
            a1 = ordered.running_sum(series, *args, b, descending).withColumn("x", F.coalesce("x", F.lit(0)))
            a2 = ordered.running_sum(series, *args, None, descending).withColumn("x", F.coalesce("x", F.lit(0)))
            same(a1, a2, ["k", "p", "x"])
    for inclusive in (False, True):
        for backward in (False, True):
            same(ordered.carry(series, ["k"], ["p"], F.col("v"), "x", b, inclusive, backward), ordered.carry(series, ["k"], ["p"], F.col("v"), "x", None, inclusive, backward), ["k", "p", "x"])
    same(ordered.row_index(series, ["k"], ["p"], "x", b, 5), ordered.row_index(series, ["k"], ["p"], "x", None, 5), ["k", "p", "x"])
    same(ordered.next_row(series, ["k"], ["p"], ["p", "v"], "x", b), series.withColumn("x", F.lead(F.struct("p", "v")).over(Window.partitionBy("k").orderBy("p"))), ["k", "p", "x"])
    same(ordered.previous_row(series, ["k"], ["p"], ["p"], "x", b), series.withColumn("x", F.lag(F.struct("p")).over(Window.partitionBy("k").orderBy("p"))), ["k", "p", "x"])


def test_preceding_rows_across_blocks(series):
    filled = series.fillna(-1)
    same(ordered.preceding_rows(filled, ["k"], ["p"], F.col("v"), 4, "x", F.floor(F.col("p") / 50), width=8), ordered.preceding_rows(filled, ["k"], ["p"], F.col("v"), 4, "x"), ["k", "p", "x"])


def test_percentiles(series):
    got = {r["k"]: r for r in ordered.percentiles(series, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}, 2.0).collect()}
    for k in got:
        vals = [r["v"] for r in series.where((F.col("k") == k) & F.col("v").isNotNull()).collect()]
        assert [got[k][x] for x in "abc"] == pytest.approx([np.percentile(vals, q) for q in (50, 95, 0)])


def test_top_k_limits_before_the_shuffle(series):
    p = plan(ordered.top_k(series, ["k"], [F.col("p")], 3))
    assert p.count("WindowGroupLimit") == 2


# ------------------------------------------------------------------ search

@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m[150:250] = m[0]  # a third are copies of one vector
    rows = [(i, m[i].astype("float32").tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 8)]
    return spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").repartition(5).cache(), m.astype("float32").astype(float)


def brute(m, qs, k, floor=None):
    out = set()
    for q in qs:
        s = [(-round(float(m[q] @ m[i] / math.sqrt((m[q] @ m[q]) * (m[i] @ m[i]))), 9), i) for i in range(len(m))]
        s = [x for x in sorted(s) if floor is None or -x[0] > floor]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("limit,floor", [(S.BROADCAST_BYTES, None), (64, None), (S.BROADCAST_BYTES, 0.3), (64, 0.3)])
def test_exact_search_both_ways(vecs, limit, floor, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 37)
    df, m = vecs
    q = df.where("chunk_id < 12").withColumnRenamed("chunk_id", "query_id")
    got = S.semantic_topk(q, df, 7, floor, broadcast_bytes=limit)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()} == brute(m, range(12), 7, floor)
    assert "CartesianProduct" not in plan(got)


def test_search_with_string_ids_and_no_queries(vecs):
    df, m = vecs
    s = df.select(F.concat(F.lit("c"), F.lpad(F.col("chunk_id").cast("string"), 4, "0")).alias("chunk_id"), "embedding")
    q = df.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    assert {(r[0], int(r[1][1:]), r["rank"]) for r in S.semantic_topk(q, s, 5).collect()} == brute(m, range(3), 5)
    assert S.semantic_topk(q.where("false"), df, 5).count() == 0


def test_approximate_search(vecs):
    df, m = vecs
    q = df.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    model, cells = S.build_cells(df.where("chunk_id < 900"), 6)
    for limit in (S.BROADCAST_BYTES, 64):
        full = S.ann_topk(q, cells, model, 5, 6, broadcast_bytes=limit)
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in full.collect()} == brute(m, range(40), 5)
    near = S.ann_topk(q, cells, model, 5, 4)
    found = {(r["query_id"], r["chunk_id"]) for r in near.collect()}
    want = {(a, b) for a, b, _ in brute(m, range(40), 5)}
    assert len(found & want) / len(want) >= 0.9


def test_trigram_ways_agree(spark):
    words = ["alpha", "beta", "gamma", "delta", "a", "x1", "übung"]
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(80)]
    c = spark.createDataFrame(texts, "chunk_id int, text string")
    q = c.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "text")

    def tri(t):
        import re
        return {f"  {w} "[i:i + 3] for w in re.findall(r"[^\W_]+", t.lower()) for i in range(len(w) + 1)}
    want = set()
    for i, t in texts[:20]:
        for j, u in texts:
            a, b = tri(t), tri(u)
            if a | b and round(len(a & b) / len(a | b), 9) >= 0.3:
                want.add((i, j, round(len(a & b) / len(a | b), 9)))
    for limit in (4096, 1):
        S.MAX_SCAN_QUERIES, old = limit, S.MAX_SCAN_QUERIES
        got = {(r["query_id"], r["chunk_id"], r["score"]) for r in S.trigram_topk(q, c, 1000).collect()}
        S.MAX_SCAN_QUERIES = old
        assert got == want


def test_fusion_keeps_rows_of_one_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 12, 1)], "query_id int, chunk_id int, rank int")
    got = {(r["query_id"], r["chunk_id"]): (r["rank"], r["search_type"]) for r in S.fuse(a, b, 5).collect()}
    assert got == {(1, 11): (1, "semantic + keyword"), (1, 10): (2, "semantic"), (1, 12): (3, "keyword"), (2, 12): (1, "keyword")}
    flipped = {(r["query_id"], r["chunk_id"]): r["rrf_score"] for r in S.fuse(b, a, 5).collect()}
    assert flipped == {(r["query_id"], r["chunk_id"]): r["rrf_score"] for r in S.fuse(a, b, 5).collect()}
    left = {r["chunk_id"]: r["keyword_rank"] for r in S.fuse_left(a, b, 5).collect()}
    assert left == {10: 16, 11: 1}


def test_neighbours_at_the_first_chunk(spark):
    chunks = spark.createDataFrame([(7, i, f"c{i}") for i in range(6)], "document_id int, chunk_index bigint, content string")
    hits = spark.createDataFrame([(1, 1, 7, "f", 0, "c0"), (1, 2, 7, "f", 1, "c1"), (1, 3, 7, "f", 5, "c5"), (1, 4, 9, "g", 3, "gone")],
                                 "query_id int, rank int, document_id int, file_name string, chunk_index bigint, content string")
    got = {r["rank"]: r["content"] for r in S.expand_neighbours(hits, chunks).collect()}
    assert got == {1: "c0\n\nc1\n\nc2", 3: "c3\n\nc4\n\nc5", 4: "gone"}


def test_inverted_index_written_by_term_bucket(spark, tmp_path):
    c = spark.createDataFrame([(1, "a b b"), (2, "b c")], "chunk_id int, text string")
    S.write_postings(c, str(tmp_path / "ix"), buckets=4, salts=2)
    got = {(r["term"], r["chunk_id"], r["tf"], r["doc_len"]) for r in spark.read.parquet(str(tmp_path / "ix")).collect()}
    assert got == {("a", 1, 1, 3), ("b", 1, 2, 3), ("b", 2, 1, 2), ("c", 2, 1, 2)}


def test_model_rerank(spark):
    h = spark.createDataFrame([(1, 1, 3.0), (1, 2, None), (1, 3, 9.0), (2, 1, None), (2, 2, None)], "query_id int, original_rank int, raw double")
    got = [(r["query_id"], r["original_rank"]) for r in rerank.model_rerank(h, "raw").orderBy("query_id", "rank").collect()]
    assert got == [(1, 3), (1, 2), (1, 1), (2, 1), (2, 2)]


# ------------------------------------------------------------------ prefilter

def test_prefilter_fallbacks_and_both_scans(spark, monkeypatch):
    docs = spark.createDataFrame([
        ("u", i, i, n, d) for i, (n, d) in enumerate([("Federal-Decree-Law 47", None), ("Corporate Tax general guide", "loss relief"), ("Executive Regulation 1", None),
                                                     ("notes", "small business relief"), ("small_business.pdf", None)] + [(f"filler {i}", None) for i in range(20)])
    ] + [("v", 100 + i, i, f"plain {i}", None) for i in range(4)], "owner string, document_id int, pos int, name string, description string")
    qs = spark.createDataFrame([("u", 1, "small business relief"), ("u", 2, "Article 5 zzz"), ("u", 3, "qqq"), ("v", 4, "qqq"), ("w", 5, "none")], "owner string, query_id int, question string")

    def run():
        return {(r["query_id"], r["rank"]): (r["document_id"], r["score"]) for r in P.prefilter_documents(qs, docs, 3).collect()}
    got = run()
    monkeypatch.setattr(P, "MAX_SCAN_TERMS", -1)
    assert run() == got
    # 3 terms in the description and the phrase there; name with the phrase and two terms
    assert got[(1, 1)] == (4, 40) and got[(1, 2)] == (3, 30)
    assert {got[(2, i)] for i in (1, 2, 3)} == {(0, 50), (1, 50), (2, 30)}
    assert {got[(3, i)][0] for i in (1, 2)} == {0, 1}
    assert [got[(4, i)][0] for i in (1, 2, 3)] == [100, 101, 102]
    assert not any(k[0] == 5 for k in got)


# ------------------------------------------------------------------ chunks and pages

@pytest.mark.parametrize("n,want", [(0, []), (1, [1]), (1000, [1000]), (1001, [1000, 151]), (1850, [1000, 1000]), (1851, [1000, 1000, 151])])
def test_fixed_chunks(spark, n, want):
    df = spark.createDataFrame([("x" * n,)], "t string")
    rows = chunking.fixed_chunks(df, "t").orderBy("chunk_index").collect()
    assert [len(r["content"]) for r in rows] == want


def pack(tokens, limit, overlap):
    """Greedy packing page by page."""
    total = sum(tokens)
    if total <= limit:
        return {(i, 0) for i in range(len(tokens))}
    budget = math.ceil((total / math.ceil(total / limit) + limit) / 2)
    out, start, held, g = set(), 0, 0, 0
    for i, t in enumerate(tokens):
        if held + t > budget and i > start:
            start, g = max(i - overlap, 0), g + 1
            held = sum(tokens[start:i])
            out |= {(j, g) for j in range(start, i)}
        held += t
        out.add((i, g))
    return out


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_page_groups(spark, overlap):
    rng = random.Random(overlap)
    docs = {"a": [rng.randint(0, 40) for _ in range(90)], "b": [5, 6], "c": [500, 1, 1, 700, 0, 0, 90], "d": [100]}
    rows = [(d, i + 1, t) for d, ts in docs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, token_count int")
    got = {(r["document_id"], r["page_number"] - 1, r["group_no"]) for r in chunking.pages_of_groups(df, "document_id", "page_number", "token_count", 100, overlap, 16).collect()}
    assert got == {(d, i, g) for d, ts in docs.items() for i, g in pack(ts, 100, overlap)}


# ------------------------------------------------------------------ trees

def test_parents_take_the_latest_earlier_row(spark):
    rows = [(0, "1"), (1, "1.1"), (2, "1"), (3, "1.2"), (4, "2.1"), (5, "2"), (6, None), (7, "1.2.9")]
    toc = spark.createDataFrame([("d", p, s) for p, s in rows], "document_id string, pos bigint, structure string")
    assert {r["pos"]: r["parent_pos"] for r in R.parents(toc).collect()} == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: None, 6: None, 7: 3}


def test_offset_ties(spark):
    pairs = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 5, 4), ("b", 5, 3), ("c", 1, 3), ("c", 1, 2)], "document_id string, page int, physical_index int")
    assert {r["document_id"]: r["offset"] for r in R.page_offsets(pairs).collect()} == {"a": 2, "b": -2, "c": 1}


def test_toc_run_stops_at_the_first_gap(spark):
    pages = spark.createDataFrame([("a", i, i in (2, 3, 5, 19, 21)) for i in range(1, 25)] + [("b", 1, False)], "document_id string, page_number int, t boolean")
    assert [r["page_number"] for r in R.toc_pages(pages, F.col("t")).orderBy("page_number").collect()] == [2, 3]


def test_toc_lines(spark):
    pages = spark.createDataFrame([("d", 2, "Contents\n1 Scope........3\n1.2 Terms used : 4\nAnnex   12\nno number")], "document_id string, page_number int, text string")
    got = [(r["structure"], r["title"], r["page"]) for r in R.toc_rows(pages).orderBy("pos").collect()]
    assert got == [("1", "Scope", 3), ("1.2", "Terms used", 4), (None, "Annex", 12)]


def test_model_replies_to_rows(spark):
    df = spark.createDataFrame([("d", 0, '```json\n[{"structure": "1", "title": "A", "physical_index": "<physical_index_4>"},]\n```'), ("d", 1, '[{"structure":"2","title":"B","physical_index":"7"}]'), ("e", 0, "nonsense")],
                               "document_id string, part int, reply string")
    assert [(r["document_id"], r["pos"], r["title"], r["physical_index"]) for r in R.toc_from_replies(df).orderBy("pos").collect()] == [("d", 0, "A", 4), ("d", 1, "B", 7)]


def test_repair_finds_the_page(spark):
    pages = spark.createDataFrame([("d", i, f"chapter {'abcdefgh'[i - 1]} text") for i in range(1, 9)], "document_id string, page_number int, text string")
    toc = spark.createDataFrame([("d", 0, "Chapter A", 1), ("d", 1, "chapter d", 2), ("d", 2, "chapter f", 6), ("d", 3, "chapter z", 7)], "document_id string, pos bigint, title string, physical_index int")
    bounds = spark.createDataFrame([("d", 1, 8)], "document_id string, first_page int, last_page int")
    v = R.verify_rows(toc, pages)
    assert {r["document_id"]: r["plan"] for r in R.toc_accuracy(v).collect()} == {"d": "regenerate"}
    got = {r["pos"]: (r["physical_index"], r["is_correct"]) for r in R.repair_rows(v, pages, bounds).collect()}
    assert got == {0: (1, True), 1: (4, True), 2: (6, True), 3: (7, False)}


def test_large_nodes_are_split(spark):
    pages = spark.createDataFrame([("d", i, "t", 10) for i in range(1, 101)], "document_id string, page_number int, text string, token_count int")
    nodes = spark.createDataFrame([("d", [0], "Root", 1, 90), ("d", [0, 1], "old child", 2, 3), ("d", [2], "Other", 90, 100)], "document_id string, path array<bigint>, title string, start_index int, end_index int")
    rows = [("d", [0], 0, "1", "Root", 1, "yes"), ("d", [0], 1, "2", "First", 5, "no"), ("d", [0], 2, "2.1", "Inner", 40, "yes")]
    schema = "document_id string, parent_path array<bigint>, pos bigint, structure string, title string, physical_index int, appear_start string"

    def contents(big, _):
        return spark.createDataFrame(rows, schema).join(big.select("document_id", F.col("path").alias("parent_path")), ["document_id", "parent_path"], "left_semi")
    out = R.split_large_nodes(nodes, pages, contents, max_pages=50, max_tokens=500)
    assert {(tuple(r["path"]), r["title"], r["start_index"], r["end_index"]) for r in out.collect()} == {
        ((0,), "Root", 1, 5), ((0, 1), "First", 5, 39), ((0, 1, 2), "Inner", 40, 90), ((2,), "Other", 90, 100)}
    ids = R.number_nodes(out)
    assert {r["title"]: (r["node_id"], r["parent_id"], r["depth"]) for r in ids.collect()} == {"Root": ("0000", None, 0), "First": ("0001", "0000", 1), "Inner": ("0002", "0001", 2), "Other": ("0003", None, 0)}


# ------------------------------------------------------------------ models

def test_batch_infer_retries(spark):
    df = spark.createDataFrame([("a",), ("b",), ("bad",)], "p string").coalesce(1)

    def client():
        seen = {"n": 0}

        def call(prompts):
            seen["n"] += 1
            if seen["n"] == 1 or "bad" in prompts:
                raise RuntimeError("down")
            return [p.upper() for p in prompts]
        return call
    got = {r["p"]: r["r"] for r in infer.batch_infer(df, "p", "r", client, batch=2, pause=0.0).collect()}
    assert got == {"a": "A", "b": "B", "bad": None}


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "article 5 tax"), (2, "Article 5 tax"), (3, " "), (4, "other words entirely")], "i int, t string")
    got = {r["i"]: r["e"] for r in df.withColumn("e", infer.embed(F.col("t"))["vector"]).collect()}
    assert got[1] == got[2] and got[3] is None and np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-5)
    model = infer.embedding_model(df, "t", 64)
    out = infer.embedded(model, df).where("i in (1, 2)").collect()
    assert out[0]["embedding"] == out[1]["embedding"] and len(out[0]["embedding"]) == 64


def test_judge_scores(spark):
    df = spark.createDataFrame([("85",), (" 120 points",), ("-3",), ("none",), (None,)], "r string")
    assert [r[0] for r in df.select(infer.judge_score(F.col("r"))).collect()] == [85, 100, 0, 50, 50]


def test_mean_query_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "query_id int, embedding array<float>")
    assert {r[0]: r[1] for r in S.mean_query_vectors(df).collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    assert df.groupBy().agg(F.first(V.norm(F.col("embedding")))).first()[0] == pytest.approx(math.sqrt(5))


# ------------------------------------------------------------------ tables, evaluation, files

def test_feedback_changes_only_type_and_text(spark):
    cols = "user_id int, message_id int, ts int, query string, feedback_type string, feedback_text string"
    ev = spark.createDataFrame([(1, 1, 1, "q1", "up", "a"), (1, 1, 3, "q3", "down", None), (1, 1, 2, "q2", "up", "b")], cols)
    folded = tables.fold_feedback(ev, ["user_id", "message_id"], ["query"], ["feedback_type", "feedback_text"], ["ts"])
    assert [tuple(r) for r in folded.collect()] == [(1, 1, "q1", "down", None)]
    target = spark.createDataFrame([(1, 1, "old", "up", "x"), (2, 2, "keep", "up", "y")], "user_id int, message_id int, query string, feedback_type string, feedback_text string")
    out = {(r[0], r[1]): tuple(r)[2:] for r in tables.merge_feedback(target, folded, ["user_id", "message_id"], ["feedback_type", "feedback_text"]).collect()}
    assert out == {(1, 1): ("old", "down", None), (2, 2): ("keep", "up", "y")}


def test_as_of_ties_and_gaps(spark):
    ev = spark.createDataFrame([("a", 1, 10, "x"), ("a", 2, 10, "y"), ("a", 3, 20, "z")], "k string, event_id bigint, ts int, s string")
    pr = spark.createDataFrame([("a", 9), ("a", 10), ("a", 19), ("a", 25), ("b", 5)], "k string, ts int")
    got = {(r["k"], r["ts"]): r["state"] for r in tables.as_of(pr, ev, "k", "ts", "s", "state", F.floor(F.col("ts") / 10)).collect()}
    assert got == {("a", 9): None, ("a", 10): "y", ("a", 19): "y", ("a", 25): "z", ("b", 5): None}


def test_mean_rank_without_hits(spark):
    df = spark.createDataFrame([(None,), (None,)], "r int")
    assert df.agg(E.mean_rank(F.col("r"))).first()[0] == 999.0


def test_reports(spark):
    s = spark.createDataFrame([("a", 0.5, 10.0, 1), ("b", 0.5, 5.0, 2), ("c", 0.1, 5.0, 3)], "model string, avg_score double, avg_time double, name_rank int")
    assert tuple(E.best_and_fastest(s).first()) == ("a", "b")
    w = spark.createDataFrame([("x", 0.9), ("y", 0.5), ("z", 0.2)], "category string, success_rate double")
    assert [r[0] for r in E.weak_categories(w).collect()] == ["z", "y"]
    d = spark.createDataFrame([("m", 1.0)], "metric string, value double")
    assert E.metric_deltas(d, d.withColumn("value", F.lit(3.0))).first()["delta"] == 2.0
    lat = spark.createDataFrame([(100.0, 300.0), (200.0, 300.0)], "a double, b double").agg(E.latency_change(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert (lat["delta"], lat["share"]) == (150.0, 1.0)


def test_tiers_and_context(spark):
    h = spark.createDataFrame([(1, f"f{i % 2}", 1.0 - i / 10, i) for i in range(7)], "query_id int, file_name string, similarity double, pos int")
    got = {(r["tier"], r["file_name"]): (r["file_pos"], r["n_sources"]) for r in context.tiered_sources(h, 7).collect()}
    assert got == {("top", "f0"): (1, 3), ("top", "f1"): (2, 2), ("other", "f1"): (1, 1), ("other", "f0"): (2, 1)}
    b = spark.createDataFrame([(1, 1, "p", 1, 2, "", "s")], "query_id int, rank int, section_path string, page_start int, page_end int, content string, summary string")
    assert context.context_blocks(b).first()["context"] == "[1] p (Pages 1-2)\nSummary: s\n\nContent not available."


def test_timing(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("r", t0, t0 + dt.timedelta(milliseconds=ms)) for ms in (500, 600, 1500)] + [("s", t0, t0)], "q string, started timestamp, ts timestamp")
    got = {r["q"]: r for r in conversation.request_timing(ev, "q", "ts", F.col("started")).collect()}
    assert (got["r"]["ttft_ms"], got["r"]["stream_ms"], got["r"]["tokens_per_second"]) == (500.0, 1000.0, 3.0)
    assert got["s"]["tokens_per_second"] == 0.0


def test_file_extraction(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  hello \n")
    (tmp_path / "b.html").write_text("<p>x</p><script>y</script>")
    (tmp_path / "c.exe").write_text("no")
    (tmp_path / "e.txt").write_text("   ")
    (tmp_path / "p.pdf").write_bytes(b"one\x0c \x0cthree")
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>Hi </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p></w:document>')
    raw = files.read_files(spark, str(tmp_path))
    ok, rejected = files.split_supported(raw)
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in rejected.collect()} == {"c.exe": "unsupported file type"}

    def pdf(content):
        return content.decode().split("\x0c")
    got = {(r["path"].rsplit("/", 1)[1], r["page_number"]): r["text"] for r in files.extract_pages(ok, pdf).collect()}
    failed = got.pop(("bad.docx", None))
    assert "BadZipFile" in failed
    assert got == {("a.txt", 1): "hello", ("b.html", 1): "x y", ("p.pdf", 1): "one", ("p.pdf", 3): "three", ("d.docx", 1): "Hi you"}
    kept = files.extract_pages(ok, pdf, keep_blank=True).where(F.col("path").endswith("p.pdf"))
    assert kept.count() == 3
    assert files.with_token_counts(kept).agg(F.sum("token_count")).first()[0] == 4
    assert files.with_token_counts(kept, lambda: lambda t: len(t.split())).agg(F.sum("token_count")).first()[0] == 2


def test_question_sets(spark, tmp_path):
    rows = [{"id": f"q{i}", "query": "x", "category": c, "difficulty": "easy", "expected_keywords": [], "expected_articles": [], "curation": {"status": s}}
            for i, (c, s) in enumerate([("a", "active"), ("negative", "active"), ("a", "draft"), ("b", "active")])]
    (tmp_path / "d.json").write_text(json.dumps({"questions": rows, "metadata": {"version": 1}}, indent=1))
    q = questions.load_questions(spark, str(tmp_path / "d.json"))
    assert [r["id"] for r in questions.select_questions(q).orderBy("id").collect()] == ["q0", "q3"]
    assert [r["id"] for r in questions.select_questions(q, ids=["q1"]).collect()] == ["q1"]
    assert [r["id"] for r in questions.select_questions(q, category="b", limit=1).collect()] == ["q3"]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([(1, i, "Some text", [0.1] * n) for i, n in enumerate((384, 1536, 3))], "document_id int, chunk_index int, content string, embedding array<float>")
    sinks.append_chunks(c, str(tmp_path / "c"), buckets=4)
    got = {r["chunk_index"]: (r["embedding_local"] is not None, r["embedding_openai"] is not None, r["tokens"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {0: (True, False, ["some", "text"]), 1: (False, True, ["some", "text"]), 2: (False, False, ["some", "text"])}
    rows = spark.createDataFrame([("1", 'a "q"', "c", "e", "P1", True, 0.5, 10, 0.1, "two\nlines")], "id string, query string, category string, difficulty string, configuration string, passed boolean, accuracy double, duration int, cost double, response string")
    wide = sinks.comparison_rows(rows, ["P1", "P2"])
    sinks.write_comparison_csv(wide.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert '"a ""q"""' in text and "50%" in text and "0.10000" in text and "two lines" in text
    sinks.write_results(wide, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_contents_and_descriptions_by_model(spark):
    pages = spark.createDataFrame([("d", i, f"page {i}", 10) for i in range(1, 6)], "document_id string, page_number int, text string, token_count int")

    def client():
        import re
        def call(prompts):
            return [json.dumps([{"structure": n, "title": f"T{n}", "physical_index": f"<physical_index_{n}>"} for n in dict.fromkeys(re.findall(r"<physical_index_(\d+)>", p))]) for p in prompts]
        return call
    got = [(r["pos"], r["title"], r["physical_index"]) for r in R.contents_by_model(pages, client, "{text}", 20).orderBy("pos").collect()]
    assert [g[2] for g in got] == sorted(g[2] for g in got) and {g[2] for g in got} == {1, 2, 3, 4, 5}
    nodes = spark.createDataFrame([("d", [0], "0000", "A"), ("d", [1], "0001", "B")], "document_id string, path array<bigint>, node_id string, title string")
    assert R.describe_documents(nodes, lambda: (lambda ps: [p.upper() for p in ps]), "about {outline}").first()["description"] == 'ABOUT [{"TITLE":"A","NODE_ID":"0000"},{"TITLE":"B","NODE_ID":"0001"}]'


def test_status_keeps_error_text(spark):
    ev = spark.createDataFrame([("f", 1, 1, "pending", None), ("f", 2, 2, "failed", "bad file"), ("f", 3, 3, "processing", None), ("f", 4, 4, "completed", None)], "id string, event_id int, ts int, status string, error string")
    r = tables.fold_status(ev, "id", "status", "ts", "event_id", F.floor(F.col("ts") / 2), extra=("error",)).first()
    assert (r["status"], r["processed_at"], r["n_updates"], r["error"]) == ("completed", 2, 4, "bad file")
