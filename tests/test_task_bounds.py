"""What a task holds at once does not grow with its rows."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexloom.operators import prefilter as P, search as S
from lexloom.plans import common


def test_vectors_are_compared_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(S, "_ROWS", 16)
    monkeypatch.setattr(S, "_SLICE", 8)
    shapes, add = [], S._Best.add
    monkeypatch.setattr(S._Best, "add", lambda self, first, sims, ids: (shapes.append(sims.shape), add(self, first, sims, ids)))
    rng = np.random.default_rng(3)
    q, v = S._units(rng.integers(-2, 3, (21, 3)) + 0.5), rng.integers(-1, 2, (150, 3)).astype(float)  # many ties, vectors of length zero
    ids = rng.permutation(150)
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("similarity", pa.float64())])
    best = S._Best(21, 5)
    S._score(best, q, v, ids, 0.1)
    got = [tuple(r.values()) for b in best.rows(list(range(21)), schema) for r in b.to_pylist()]
    with np.errstate(invalid="ignore", divide="ignore"):
        sims = np.round(S._units(v) @ q.T, 9)
    want = [(j, int(i), float(-s)) for j in range(21) for s, i in sorted((-sims[r, j], ids[r]) for r in range(150) if sims[r, j] > 0.1)[:5]]
    assert got == want
    assert max(a for a, _ in shapes) <= 16 and max(b for _, b in shapes) <= 8


def test_words_are_coded_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(S, "_TOKENS", 10)
    lists = [["a", "b"], None, [], ["b"] * 25, ["c"], ["a"] * 9, ["a", "c"]] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["chunk_id", "__w"])
    parts = list(S._parts(iter([batch.slice(1)])))
    assert pa.Table.from_batches(parts).to_pylist() == batch.slice(1).to_pylist() and len(parts) > 5
    counted = [r for b in S._count_terms(pa.array(["a", "b"]))(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_len"], dict(zip(r["terms"], r["tfs"]))) for r in counted[:5]] == [(2, {0: 1, 1: 1}), (None, {}), (0, {}), (25, {1: 25}), (1, {})]


def test_points_meet_questions_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "_SCORE_CELLS", 40)
    shapes, merge = [], P._merge
    monkeypatch.setattr(P, "_merge", lambda old, score, *rest: (shapes.append(score.shape), merge(old, score, *rest))[1])
    arrow = pa.schema([("question_no", pa.int32()), ("document_id", pa.int64()), ("pos", pa.int64()), ("score", pa.int64())])
    rows = [(i, 100 - i, " ".join("tax relief loss".split()[: i % 4])) for i in range(60)]
    docs = pa.RecordBatch.from_pydict({
        "owner": ["o"] * 60, "document_id": [r[0] for r in rows], "pos": [r[1] for r in rows], "low_name": [""] * 60, "low_text": [r[2] for r in rows],
        "phrases": pa.array([[0] * len(P.vocab.PREFILTER_PHRASES)] * 60, pa.list_(pa.int32())), "core": [False] * 60, "regulation": [False] * 60})
    asked = [({"tax": 1}, [False] * len(P.vocab.PREFILTER_PHRASES), False), ({"loss": 2}, [False] * len(P.vocab.PREFILTER_PHRASES), False)] * 4
    for positive in (True, False):
        run = P._scored(asked, {"o": list(range(8))}, ["loss", "tax"], 3, positive, True, arrow)
        got = sorted(tuple(r.values()) for b in run(iter([docs])) for r in b.to_pylist())
        want = []
        for n, (terms, _, _) in enumerate(asked):
            scores = sorted((-sum(5 * k for t, k in terms.items() if t in text), pos, i) for i, pos, text in rows)
            want += [(n, i, pos, -s) for s, pos, i in scores[:3] if -s > (0 if positive else -1)]
        assert got == sorted(want)
    assert max(a * b for a, b in shapes) <= 40


def test_orders_of_one_row_group_fill_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_TASK", 50)
    o = spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"))
    o.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for made in (common.questions, common.answers):
        sizes = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 40 and max(r["count"] for r in sizes) <= 100
