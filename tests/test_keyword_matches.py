"""All chunks with all terms of a query, however many there are."""
from pyspark.sql import functions as F

from lexloom.operators import search as S
from lexloom.plans.document_catalog import locate_passages
from tests.test_keyword_topk import tables


def test_same_as_all_pairs(spark):
    queries, corpus = tables(spark)
    terms = S.query_terms(queries)
    want = S.keyword_scores(terms, corpus, "and").select("query_id", "chunk_id").collect()
    got = S.keyword_matches(terms, corpus.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    assert S.keyword_matches(S.query_terms(queries.limit(0)), corpus).count() == 0
    assert S.keyword_matches(terms, corpus.limit(0)).count() == 0


def test_passage_in_many_documents(spark, tmp_path):
    passage = "Every lender keeps a ledger of the loans granted"
    rows = [(i, f"{'lender ledger loans granted keeps every ' * (i % 3)}Start {i}. {passage}, end.", "en", "host") for i in range(25)]
    rows += [(100 + i, "every lender keeps loans and a granted ledger", "en", "host") for i in range(15)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(0).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0)).alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = locate_passages(spark, str(tmp_path)).collect()
    assert sorted(r.chunk_id for r in got) == list(range(25))
