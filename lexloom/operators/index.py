"""A stored inverted index and keyword search from it.

Postings of a term stand in the order of what they add to a score, highest first, in blocks of
bounded size, in folders by hash of the term. A search reads the folders of the asked terms
only. The k-th posting of any one term is a score that k chunks reach; a block that cannot
reach it even with the most that the other terms of the query give is left unread. Only
postings that may matter are expanded, so a frequent term costs its first blocks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.operators import search
from lexloom.operators.ordered import top_k
from lexloom.operators.rows import computed
from lexloom.session import checkpoint, small

BLOCK = 512
BUCKETS = 256
FIRSTS = 64  # highest postings of a term kept in the dictionary, so searches for up to that many results can skip blocks


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counts(corpus: DataFrame, cid: str, text: str) -> DataFrame:
    """``search.postings``, counted inside tasks for all chunks whose id stands in one row only."""
    words = computed(corpus.select(F.col(cid).alias("chunk_id"), F.col(text).alias("__x")), "__w", search.T.tokens(F.col("__x"))).select("chunk_id", "__w")
    again = checkpoint(corpus.groupBy(F.col(cid).alias("chunk_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"), "repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in search._parts([whole]):
                lists = batch["__w"]
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                many = max(1, len(coded.dictionary))
                both, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(), return_counts=True)
                row, code = np.divmod(both, many)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(code)), batch["chunk_id"].take(pa.array(row)), pa.array(size[row]), pa.array(tf.astype(np.int64))], names=["term", "chunk_id", "doc_len", "tf"])
    shape = f"term string, chunk_id {corpus.schema[cid].dataType.simpleString()}, doc_len long, tf long"
    if again.isEmpty():
        return words.mapInArrow(run, shape)
    same = F.col("chunk_id").eqNullSafe(F.col("__again"))
    marked = words.join(small(again.withColumnRenamed("chunk_id", "__again")), same, "left_anti")
    rest = words.join(small(again.withColumnRenamed("chunk_id", "__again")), same, "left_semi")
    met = rest.select("chunk_id", F.size("__w").cast("bigint").alias("doc_len"), F.explode("__w").alias("term")).groupBy("term", "chunk_id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    return marked.mapInArrow(run, shape).unionByName(met)


def _cut(block: int, schema: pa.Schema):
    """Task that cuts its postings, in order, into blocks of one term each; the first of a term in the task is block 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, before = None, 0, None  # postings of the last term that are not in a block yet
        def blocks(rows: pa.Table, last: bool):
            nonlocal held, number, before
            terms = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
            stops = np.r_[starts[1:], len(terms)]
            cuts, numbers = [], []
            names = rows["term"].take(pa.array(starts)).to_pylist()
            held = None
            for term, a, b in zip(names, starts.tolist(), stops.tolist()):
                if term != before:
                    before, number = term, 0
                while a < b:
                    if b - a < block and b == len(terms) and not last:
                        held = rows.slice(a)
                        break
                    cuts.append((a, min(a + block, b)))
                    numbers.append(number)
                    a, number = min(a + block, b), number + 1
            if not cuts:
                return
            first, stop = np.array([c[0] for c in cuts]), cuts[-1][1]
            used = rows.slice(0, stop).combine_chunks()
            share, chunk = used["share"].combine_chunks(), used["chunk_id"].combine_chunks()
            postings = pa.ListArray.from_arrays(pa.array(np.r_[first, stop].astype(np.int32)), pa.StructArray.from_arrays([share, chunk], ["share", "chunk_id"]))
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([used["bucket"].combine_chunks().take(at), used["term"].combine_chunks().take(at), pa.array(numbers, pa.int64()), share.take(at), postings.cast(schema.field("postings").type)], schema=schema)
        for batch in batches:
            if batch.num_rows:
                yield from blocks(pa.concat_tables([held, pa.table(batch)]) if held is not None else pa.table(batch), False)
        if held is not None:
            yield from blocks(held, True)
    return run


def write_index(corpus: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK, k1: float = 1.2, b: float = 0.75,
                cid: str = "chunk_id", text: str = "text") -> None:
    """Writes ``path``/blocks, /terms and /size for a corpus of (chunk_id, text).

    A posting holds its chunk and its share of BM25 without the rarity of the term. Postings
    are counted where their text is and shuffled once, by range of folder, term and share, with
    bounds that Spark draws: a hot term fills many tasks, each of which cuts its own blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    size = corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(F.col(text), F.lit(search.T.WORD))).alias("avg_len"))
    checkpointed = checkpoint(size, "index-size")
    mean = checkpointed.first()["avg_len"] or 1.0
    checkpointed.write.parquet(f"{path}/size")
    tf = F.col("tf")
    share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.lit(mean)))
    rows = _counts(corpus, cid, text).select(_bucket("term", buckets).alias("bucket"), "term", "chunk_id", share.alias("share"))
    order = ["bucket", "term", F.desc("share"), "chunk_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = corpus.schema[cid].dataType
    arrow = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("block", pa.int64()), ("highest", pa.float64()),
                       ("postings", pa.list_(pa.struct([("share", pa.float64()), ("chunk_id", to_arrow_type(kind))])))])
    cut = placed.mapInArrow(_cut(block, arrow), f"bucket int, term string, block long, highest double, postings array<struct<share:double,chunk_id:{kind.simpleString()}>>")
    cut.write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = corpus.sparkSession.read.parquet(f"{path}/blocks")
    # the highest of a term stand in the first blocks that tasks cut of it, more of them where blocks are small
    heads = F.when(F.col("block") * block < FIRSTS, F.transform(F.slice("postings", 1, FIRSTS), lambda p: p["share"]))
    terms = blocks.groupBy("bucket", "term").agg(F.sum(F.size("postings")).alias("df"), F.max("highest").alias("highest"), F.flatten(F.collect_list(heads)).alias("firsts"))
    terms = terms.withColumn("firsts", F.slice(F.sort_array("firsts", False), 1, FIRSTS))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")


def keyword_topk(spark: SparkSession, path: str, terms: DataFrame, k: int, match: str = "or", buckets: int = BUCKETS) -> DataFrame:
    """(query_id, chunk_id, score, n_hit, rank) as ``search.keyword_topk`` gives, read from the index.

    terms: query_id, term, n_terms. An AND search reads all blocks of its terms.
    """
    n = spark.read.parquet(f"{path}/size").first()["n"]
    asked = checkpoint(terms.select("query_id", "term", "n_terms").withColumn("bucket", _bucket("term", buckets)), "terms")
    wanted = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # ``buckets`` at most
    dictionary = spark.read.parquet(f"{path}/terms").where(F.col("bucket").isin(*wanted))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(dictionary, ["bucket", "term"]).withColumn("idf", idf).withColumn("most", F.col("idf") * F.col("highest"))
    reach = F.coalesce(F.col("idf") * F.get("firsts", F.lit(k - 1)), F.lit(0.0)) if match == "or" else F.lit(0.0)
    totals = known.groupBy("query_id").agg(F.sum("most").alias("total"), F.max(reach).alias("reach"))
    ready = checkpoint(known.join(totals, "query_id").select("query_id", "bucket", "term", "n_terms", "idf", (F.col("reach") - (F.col("total") - F.col("most")) - 1e-6).alias("least")), "weights")
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("bucket").isin(*wanted))
    useful = blocks.join(small(ready), ["bucket", "term"]).where(F.col("idf") * F.col("highest") >= F.col("least"))
    hits = useful.select("query_id", "n_terms", "idf", F.inline("postings"))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * F.col("share")), 6).alias("score"), F.count(F.lit(1)).alias("n_hit"), F.max("n_terms").alias("__need"))
    if match == "and":
        scored = scored.where(F.col("n_hit") == F.col("__need"))
    return top_k(scored.drop("__need"), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
