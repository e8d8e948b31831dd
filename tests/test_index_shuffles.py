"""Writing the keyword index shuffles postings once; rows with repeated ids count as they did."""
import random

from lexloom.operators import index as IX, search as S


def test_postings_are_counted_where_their_text_is(spark):
    c = spark.createDataFrame([(1, "b a b"), (2, None), (3, "c"), (4, "")], "chunk_id long, text string")
    rows = IX._counts(c, "chunk_id", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {tuple(r) for r in rows.collect()} == {("a", 1, 3, 1), ("b", 1, 3, 2), ("c", 3, 1, 1)}


def test_repeated_and_missing_ids(spark, tmp_path):
    rng = random.Random(8)
    words = ["common"] * 20 + [f"w{i}" for i in range(9)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)]
    texts += texts[:30] + [(5, "w1 common w1 w2 w2 w2 w3"), (None, "w1 common"), (None, "w2 common"), (777, None)]
    c = spark.createDataFrame(texts, "chunk_id long, text string").repartition(5)
    key = lambda df: sorted(((r.term, -1 if r.chunk_id is None else r.chunk_id, r.doc_len, r.tf) for r in df.collect()))
    assert key(IX._counts(c, "chunk_id", "text")) == key(S.postings(c))
    path = str(tmp_path / "index")
    IX.write_index(c, path, buckets=4, block=3)
    terms = {r.term: r for r in spark.read.parquet(f"{path}/terms").collect()}
    held = {}
    for r in spark.read.parquet(f"{path}/blocks").collect():
        assert r.highest == max(p.share for p in r.postings) and len(r.postings) <= 3
        held.setdefault(r.term, []).extend(p.share for p in r.postings)
    assert set(held) == set(terms) and sum(map(len, held.values())) == S.postings(c).count()
    for term, shares in held.items():
        shares.sort(reverse=True)
        assert terms[term].df == len(shares) and terms[term].highest == shares[0] and terms[term].firsts[:64] == shares[:64]
