"""Vector search over many queries: few pairs are worked out in doubles, few copies are made, rows stay exact."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import search as S


def want(q, v, ids, k, floor=None):
    with np.errstate(invalid="ignore", divide="ignore"):
        sims = np.round(S._units(v) @ S._units(q).T, 9)
    keep = ~np.isnan(sims) if floor is None else sims > floor
    return [(j, ids[r], float(-s)) for j in range(len(q)) for s, _, r in sorted((-sims[r, j], ids[r], r) for r in np.flatnonzero(keep[:, j]))[:k]]


def scored(q, v, ids, k, floor=None, batch=700, allowed=None):
    best = S._Best(len(q), k)
    with np.errstate(invalid="ignore"):
        for a in range(0, len(v), batch):
            S._score(best, S._units(q), v[a:a + batch], ids[a:a + batch], floor, allowed)
    return [(j, best.ids[j, r].item(), best.sims[j, r].item()) for j in range(len(q)) for r in range(k) if best.sims[j, r] > -np.inf]


def test_few_pairs_are_worked_out_in_doubles(monkeypatch):
    pairs, add = [], S._Best.add
    monkeypatch.setattr(S._Best, "add", lambda self, first, sims, ids: (pairs.append(sims.size), add(self, first, sims, ids)))
    rng = np.random.default_rng(1)
    q, v = rng.standard_normal((1500, 16)), rng.standard_normal((9000, 16))
    ids = rng.permutation(9000)
    assert scored(q, v, ids, 5, batch=4000) == want(q, v, ids.tolist(), 5)
    assert sum(pairs) < 0.02 * len(q) * len(v)


@pytest.mark.parametrize("floor", [None, 0.5])
def test_pairs_closer_than_single_precision(floor):
    rng = np.random.default_rng(2)
    v = np.repeat(rng.standard_normal((12, 8)), 150, axis=0)
    v[: len(v) // 2] += rng.standard_normal((len(v) // 2, 8)) * 1e-7  # similarities differ from the 9th decimal on
    v[5::97] = 0
    v[7::211] = np.nan
    v = rng.permutation(v)
    ids = rng.permutation(len(v))
    q = np.concatenate([v[:40], v[::80]])
    assert scored(q, v, ids, 9, floor) == want(q, v, ids.tolist(), 9, floor)


def test_equal_vectors_in_any_order_of_ids():
    v = np.ones((5000, 4))
    for ids in (np.arange(5000), np.arange(5000)[::-1], np.array([f"c{i:04d}" for i in range(5000)])):
        for batch in (300, 5000):
            assert scored(v[:3], v, ids, 6, batch=batch) == want(v[:3], v, ids.tolist(), 6)


def test_vectors_whose_squares_no_double_holds():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 3)) * np.repeat([1.0, 1e-162, 1e-170, 1e200], 225)[rng.permutation(900)][:, None]
    ids = rng.permutation(900)
    with np.errstate(over="ignore"):
        assert scored(v[:30], v, ids, 4, batch=250) == want(v[:30], v, ids.tolist(), 4)


def test_only_allowed_pairs_count():
    rng = np.random.default_rng(4)
    q, v, ids = rng.standard_normal((20, 4)), rng.standard_normal((600, 4)), np.arange(600)
    may = rng.random((600, 20)) < 0.1
    got = scored(q, v, ids, 5, batch=600, allowed=lambda rows: may[rows])
    assert got == [r for j in range(20) for r in [(j, i, s) for _, i, s in want(q[j:j + 1], v, ids.tolist(), 600) if may[i, j]][:5]]


def test_a_blocked_search_makes_few_copies():
    for n in (131_073, 615_384, 3_076_920):
        n_q, n_c = S._grid(n, n, 64, 6)
        assert n / n_q * 64 * 8 <= S._MATRIX_BYTES and n_q * n_c >= 18
        assert n_q + n_c <= n / 4096 / 2  # once per 4,096 rows before, of either side


def test_blocked_rows_equal_broadcast_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "_MATRIX_BYTES", 8 * 6 * 40)
    monkeypatch.setattr(S, "_TASK_PRODUCTS", 6 * 40 * 100)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 250, 300), np.round(rng.standard_normal((300, 6)), 1))]
    rows += [(300, [0.0] * 6), (301, None), (302, [1.0, 2.0]), (303, []), rows[0], rows[0]]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(None if i == 7 else f"q{i}", v) for i, v in rows], "query_id string, embedding array<double>")
    few, many = (S.semantic_topk(queries, corpus, 4, f, broadcast_bytes=b) for f, b in ((None, 1 << 20), (None, 1)))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "CartesianProduct" not in plan
    n_q, n_c = S._grid(303, 303, 6, spark.sparkContext.defaultParallelism)
    assert n_q > 4 and n_c > 1
