"""Keys held for a time, over several batches."""
from pyspark.sql import functions as F

from tests.test_streaming import event, run, stream, write_batch

from lexloom.streaming import requests as Q


def test_keys_are_computed_again_when_their_time_is_over(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_batch(src, 1, [event("a", 700, "x"), event("a", 0, "x"), event("a", 1300, "x"), event("b", 10, "x")])
    write_batch(src, 2, [event("a", 1900, "x"), event("a", 2499, "x"), event("b", 5000, "x")])
    write_batch(src, 3, [event("a", 5100, "x"), event("b", 5001, "x"), event("late", 1, "x")])
    write_batch(src, 4, [event("a", 6400, "x"), event(None, 6400, "x")])
    keyed = stream(spark, src).withColumnRenamed("request_id", "k")
    out, _ = run(spark, Q.unseen_within(keyed, ["k"], 1200 * 1_000_000), "ttl")
    got = {(r.k, r.at // 1_000_000 - 1704067200) for r in out.select("k", F.unix_micros("ts").alias("at")).collect()}
    assert got == {("a", 0), ("a", 1300), ("b", 10), ("b", 5000), ("a", 5100), ("a", 6400), (None, 6400)}
