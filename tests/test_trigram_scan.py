"""Trigram search by scan against the set join, and how each is chosen."""
import random

from lexloom.operators import search as S


def _tables(spark, seed=3):
    rng = random.Random(seed)
    words = ["tax", "taxes", "relief", "zone", "zones", "group", "loss", "losses", "late", "filing", "Rate", "éa", "x"]
    def texts(n, most):
        return [(i, " ".join(rng.choices(words, k=rng.randint(1, most)))) for i in range(n)]
    q = texts(30, 6) + [(100, None), (101, ""), (102, " , "), (None, "late filing"), (5, "tax zone")]
    c = texts(200, 9) + [(900, None), (901, ""), (None, "late filing"), (902, "word " * 400), (7, "tax zone"), (903, "tax zone")]
    return spark.createDataFrame(q, "query_id long, text string"), spark.createDataFrame(c, "chunk_id long, text string").repartition(3)


def test_scan_and_set_join_agree(spark, monkeypatch):
    q, c = _tables(spark)
    q, c = q.where("query_id IS NULL OR query_id <> 5"), c.where("chunk_id IS NULL OR chunk_id <> 7")
    rows = lambda k: sorted(tuple(r) for r in S.trigram_topk(q, c, k).select("query_id", "chunk_id", "score", "rank").collect())
    joins = []
    real = S.similar_sets
    monkeypatch.setattr(S, "similar_sets", lambda *a: joins.append(1) or real(*a))
    for k in (3, 1000):
        got = rows(k)
        assert not joins  # a bounded query table shuffles no candidate pairs
        monkeypatch.setattr(S, "_CELLS", 600)  # many slices of queries, many parts of a batch
        assert rows(k) == got
        monkeypatch.setattr(S, "MAX_SCAN_QUERIES", 0)
        assert rows(k) == got and joins and len(got) > 60
        monkeypatch.undo()
        joins.clear()
        monkeypatch.setattr(S, "similar_sets", lambda *a: joins.append(1) or real(*a))


def test_repeated_ids_keep_their_own_texts(spark):
    q, c = _tables(spark)
    got = {(r.query_id, r.chunk_id, r.score) for r in S.trigram_topk(q, c, 1000).collect()}
    assert (5, 7, 1.0) in got and (5, 903, 1.0) in got and all(x is not None for r in got for x in r)
    assert S.trigram_topk(q.limit(0), c, 5).count() == 0 and S.trigram_topk(q, c.limit(0), 5).count() == 0
