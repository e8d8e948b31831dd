"""Keys that share a state row keep their own course, and Python is called per bucket."""
import random

from pyspark.sql import functions as F

from tests.test_streaming import event, run, stream, token, write_batch

from lexloom.streaming import requests as Q


def _plain(batches, timeout):
    """request_metrics in a loop: one row per closed request; rows behind the watermark are dropped."""
    held, out, mark = {}, [], 0
    for rows in [*batches, []]:
        fresh = {}
        for rid, s, kind in rows:
            if s * 1000 > mark or not mark:
                fresh.setdefault(rid, []).append((s, kind))
        for rid, mine in fresh.items():
            start, times, _ = held.get(rid, (None, [], 0))
            start = min([s for s, _ in mine] + ([] if start is None else [start]))
            times = times + [s for s, k in mine if k == "t"]
            if any(k == "d" for _, k in mine):
                held.pop(rid, None)
                out.append((rid, (min(times) - start) * 1000.0 if times else None, len(times), True))
            else:
                held[rid] = (start, times, max(mark, start * 1000) + timeout)
        for rid in [r for r, h in held.items() if r not in fresh and h[2] < mark]:
            start, times, _ = held.pop(rid)
            out.append((rid, (min(times) - start) * 1000.0 if times else None, len(times), False))
        mark = max([mark] + [s * 1000 - 600_000 for _, s, _ in rows])
    return sorted(out, key=str)


def test_requests_that_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "STATE_BUCKETS", 2)
    rng, src = random.Random(4), tmp_path / "in"
    src.mkdir()
    base, batches = 1704067200, []
    for n in range(4):
        rows = [(rng.choice([None, *"abcdefgh"]), n * 900 + rng.randint(0, 899), rng.choice("ttto" if n < 3 else "tod")) for _ in range(25)]
        batches.append([(r, base + s, k) for r, s, k in rows])
        write_batch(src, n, [event(r, s, {"t": token("xy"), "o": '{"thinking": "m"}', "d": "[DONE]"}[k]) for r, s, k in rows])
    out, _ = run(spark, Q.request_metrics(stream(spark, src)), "shared")
    got = sorted(((r.request_id, r.ttft_ms, r.token_count, r.finished) for r in out.collect()), key=str)
    assert got == _plain(batches, 600_000)


def test_state_rows_are_as_many_as_buckets(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_batch(src, 1, [event(f"r{i}", i, token("x")) for i in range(3 * Q.STATE_BUCKETS)])
    keyed = stream(spark, src)
    for d, name in ((Q.request_metrics(keyed), "rows-a"), (Q.unseen_within(keyed.withColumn("n", F.length("request_id").cast("bigint")), ["request_id", "n"], 10**9), "rows-b")):
        _, q = run(spark, d, name)
        assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= Q.STATE_BUCKETS
