"""Edge rows through every stage of the pipeline."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, EXTRA, frame

SF = "/root/testdata/sf0.001"
CLASHES = EXTRA + ", predicted int, n_words long, n_lines int, key_ string"


def _wide(spark, rows):
    """Rows whose other columns have the names that the stages use themselves, and a value each to find them by."""
    data = [(d, t, i, f"k{i}", i, f"s{i}", f"r{i}", f"i{i}", "host", "xx", None, i, i, i, f"u{i}") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, " + CLASHES)


def _others(df):
    return Counter(tuple(r[c] for c in df.columns if c not in ("text", "n_chars")) for r in df.collect())


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "minhash_near_dedup", "substring_dedup"])
def test_edge_rows_and_clashing_columns(spark, name):
    import corpus_pipeline
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = _wide(spark, EDGES)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert not _others(got) - _others(docs)  # no column is touched but the text and its size
    if name != "minhash_near_dedup" and name != "toxicity":
        assert _others(got) == _others(docs)
    assert got.where("n_chars != length(text)").count() == 0
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_stage_keeps_one_row_of_each_text(spark):
    import corpus_pipeline
    long = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(5, long), (5, long), (7, long), (None, long), (None, long), (None, "only here w x y z"), (None, "only here w x y z"), (8, "x y z"), (8, "q r s t u"), (9, None), (9, None), (10, ""), (None, ""), (11, "q r s t u")]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, rows), SF)
    got = Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    fixed = {(5, long): 1, (None, "only here w x y z"): 1, (9, None): 1, (10, ""): 1, (None, ""): 1}
    assert {k: got[k] for k in fixed} == fixed
    # of the texts of document 8 one keeps the id and the other comes after document 11, whichever is first by hash
    rest = Counter({k: n for k, n in got.items() if k not in fixed})
    assert rest in (Counter({(8, "x y z"): 1, (8, "q r s t u"): 1}), Counter({(8, "x y z"): 1, (11, "q r s t u"): 1}))


def test_last_stage_packs_every_row(spark):
    import corpus_pipeline
    packed = corpus_pipeline.pack(spark, _wide(spark, EDGES), SF)
    firsts = packed.where("piece = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert Counter({r.doc_id: r.n for r in firsts}) == Counter(d for d, _ in EDGES)
    assert corpus_pipeline.pack(spark, _wide(spark, EDGES).limit(0), SF).count() == 0
