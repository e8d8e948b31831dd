"""Passage location over all pairs, and the prefix-filtered set join, against plain versions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import passages as PG, search as S, setjoin

WORDS = ["taxable", "income", "exceeding", "the", "of", "relief", "portion", "small", "business", "dividend", "AED", "375,000", "x", "subject", "to", "corporate", "tax", "resident", "person", "qualifies"]


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def _passages(rng, pages):
    out = []
    for i in range(60):
        page = rng.choice(pages)[1] or ""
        at = rng.randint(0, max(0, len(page) - 60))
        cut = page[at:at + rng.choice([3, 9, 30, 60, 200, 400])]
        out.append((i, rng.choice(["", "ii ", "3) ", "Unknown leading words here now "]) + cut + rng.choice(["", " and a foreign tail"])))
    return out + [(100, None), (101, ""), (102, " .,! "), (103, "12"), (104, "a"), (105, "AED 375,000 x 9% = the portion of relief small business dividend tax"), (None, "relief")]


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_places_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(PG, "BLOCK_ANCHORS", block)
    rng = random.Random(block)
    pages = [(i, _prose(rng, rng.choice([0, 1, 4, 30, 200]))) for i in range(40)] + [(50, None), (51, ""), (52, "Relief"), (53, "é x"), (None, "relief")]
    pages += [(60 + i, "boiler plate text of every page that repeats itself " + _prose(rng, 5)) for i in range(20)]
    passages = _passages(rng, pages) + [(200, "boiler plate text of every page that repeats")]
    p = spark.createDataFrame(passages, "query_id long, text string")
    c = spark.createDataFrame(pages, "chunk_id long, text string")
    got = {(r.query_id, r.chunk_id): (r.start, r.len, r.strategy) for r in PG.locate_passages(p, c).collect()}
    every = p.crossJoin(c.withColumnRenamed("text", "page")).where("query_id IS NOT NULL AND chunk_id IS NOT NULL")
    target, full = F.substring(T.normalize_match("text"), 1, 300), T.normalize_match("page")
    want = every.where(target != "").select("query_id", "chunk_id", T.locate_normalized(target, full, empty=False).alias("at")).where("at IS NOT NULL").collect()
    assert got == {(r.query_id, r.chunk_id): tuple(r["at"]) for r in want}
    assert {s for _, _, s in got.values()} >= {"full", "head40", "clean40", "word_run"} and sum(q == 200 for q, _ in got) == 20


def test_places_of_empty_tables(spark):
    p, c = spark.createDataFrame([(1, "relief")], "query_id long, text string"), spark.createDataFrame([(1, "relief")], "chunk_id long, text string")
    assert PG.locate_passages(p, c).count() == 1
    assert PG.locate_passages(p.limit(0), c).count() == 0 and PG.locate_passages(p, c.limit(0)).count() == 0
    assert PG.locate_passages(p, c).columns == PG.locate_passages(p.limit(0), c).columns


def test_shared_stretches_share_anchors():
    rng = random.Random(2)
    for _ in range(200):
        stretch = "".join(rng.choice("abcd ") for _ in range(rng.randint(PG.RUN, 40)))
        page = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 50))) + stretch + "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 50)))
        assert set(PG.anchors(stretch, [])) <= set(PG.anchors(page, []))
        short = stretch[:rng.randint(1, 15)]
        assert set(PG._pieces(np.frombuffer(short.encode(), np.uint8), len(short))) <= set(PG.anchors(page, [len(short)]))


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_set_join_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    common = list(range(5))

    def some(i):
        base = rng.sample(range(5, 60), rng.choice([0, 1, 3, 10, 40])) + rng.sample(common, rng.randint(0, 5))
        return (i, [int(x) * (-1) ** x for x in base])
    left, right = [some(i) for i in range(60)] + [(99, None), (98, [])], [some(i) for i in range(120)] + [(500, None)]
    right += [(1000 + i, [x for x in v if rng.random() < 0.9]) for i, v in left if v]
    frames = [spark.createDataFrame(rows, "id long, elements array<long>") for rows in (left, right)]
    got = {(r.left_id, r.right_id, r.shared, round(r.score, 9)) for r in setjoin.similar_sets(*frames, threshold).collect()}
    want = set()
    for i, a in left:
        for j, b in right:
            if a and b:
                both = len(set(a) & set(b))
                score = both / (len(set(a) | set(b)))
                if score >= threshold:
                    want.add((i, j, both, round(score, 9)))
    assert got == want and want
    assert setjoin.similar_sets(frames[0].limit(0), frames[1], threshold).count() == 0
    assert setjoin.similar_sets(frames[0], frames[1].limit(0), threshold).count() == 0


def test_commonest_element_is_no_join_key(spark):
    sets = spark.createDataFrame([(i, [1, 2, *range(100 * i + 10, 100 * i + 20)]) for i in range(50)], "id long, elements array<long>")
    sized = setjoin._with_size(sets)
    ordered = setjoin.rare_first(sized, setjoin.element_counts(sized)).withColumn("class", F.lit(11))
    keys = setjoin.prefixes(ordered, spark.createDataFrame([(11, 11, 12)], "class int, other int, least int"), 0.3)
    assert not {r.element for r in keys.select("element").distinct().collect()} & {1, 2}
    longest = keys.groupBy("id").agg(F.max("place").alias("n")).first().n
    assert longest == 12 - 6 + 1  # twelve elements, six must be shared


def test_trigrams_of_all_rows_meet(spark):
    c = spark.createDataFrame([(1, "Taxable income"), (2, "taxable INCOME!"), (3, None), (4, ""), (5, "other")], "chunk_id int, text string")
    got = {(r.query_id, r.chunk_id, r.score) for r in S.trigram_topk(c.withColumnRenamed("chunk_id", "query_id"), c, 9).collect()}
    assert got == {(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (5, 5, 1.0)}
