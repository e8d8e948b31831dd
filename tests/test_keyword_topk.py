"""Keyword search whose tasks hand on k rows per query, against the scores of all pairs."""
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import search as S
from lexloom.operators.ordered import top_k


def tables(spark, n=120):
    rng = random.Random(6)
    vocabulary = ["common"] * 30 + [f"word{i}" for i in range(25)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(n)] + [(900, None), (901, "common " * 50)]
    asked = [(f"q{i}", " ".join(rng.sample(vocabulary[29:], rng.randint(1, 4)))) for i in range(15)] + [("none", "of the"), ("absent", "nowhere")]
    return spark.createDataFrame(asked, "query_id string, text string"), spark.createDataFrame(texts, "chunk_id long, text string")


@pytest.mark.parametrize("match", ["or", "and"])
@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_same_as_all_pairs(spark, match, block_bytes, monkeypatch):
    monkeypatch.setattr(S, "_PAIRS", 50)
    queries, corpus = tables(spark)
    terms = S.query_terms(queries)
    want = top_k(S.keyword_scores(terms, corpus, match), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], 7)
    got = S.keyword_topk(terms, corpus.repartition(5), 7, match, block_bytes=block_bytes)
    key = ["query_id", "rank", "chunk_id", "score", "n_hit"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_no_pairs_are_shuffled(spark):
    queries, corpus = tables(spark)
    got = S.keyword_topk(S.query_terms(queries), corpus.repartition(4), 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("Exchange") <= 2  # one exchange, shown once more by the adaptive plan
    assert S.keyword_topk(S.query_terms(queries.limit(0)), corpus, 3).count() == 0
    assert S.keyword_topk(S.query_terms(queries), corpus.limit(0), 3).count() == 0
