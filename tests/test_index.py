"""Keyword search from a stored index against the search that reads texts."""
import random

from lexloom.operators import index as IX, search as S


def test_index_gives_what_the_scan_gives(spark, tmp_path):
    rng = random.Random(4)
    words = ["common"] * 30 + ["usual"] * 10 + [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "common " * 50 + "w1")]
    c = spark.createDataFrame(texts, "chunk_id long, text string")
    q = spark.createDataFrame([(1, "w1 common"), (2, "usual w2 w3 common"), (3, "absent"), (4, "common usual"), (5, None), (6, "w4 absent")], "query_id long, text string")
    path = str(tmp_path / "index")
    IX.write_index(c, path, buckets=8, block=4)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.selectExpr("max(size(postings))").first()[0] == 4 and blocks.where("term = 'common'").count() > 20
    terms = S.query_terms(q)

    def rows(df):
        return {(r.query_id, r.chunk_id, r.score, r.n_hit, r["rank"]) for r in df.collect()}
    for k in (1, 5, 100):
        for match in ("or", "and"):
            assert rows(IX.keyword_topk(spark, path, terms, k, match, 8)) == rows(S.keyword_topk(terms, c, k, match)), (k, match)
    plan = IX.keyword_topk(spark, path, terms, 3, "or", 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan  # only the folders of asked terms
    assert IX.keyword_topk(spark, path, terms.limit(0), 3, "or", 8).count() == 0
