"""From raw documents to packed token sequences.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and
returns the columns of documents; the last returns the packed pieces. Stages are written as
Parquet in the shared folder and read again, so each can be repeated by itself.

In every stage a null text counts as empty and stays null, texts are taken whole however long,
columns besides doc_id and text are carried as they are whatever their names, and an empty
table gives an empty one. Rows without doc_id or with a repeated one are kept unless their stage
says otherwise.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from lexloom.llm.tables import prepare, table
from lexloom.session import checkpoint

TOKENIZER = "word_bpe_49k.json"
LONG_LINE = 8  # words from which a repeated line is content by itself; op2 has runs of two lines only, by its SQL
NEAR_PERCENT = 80  # op4 has 85 by its SQL; the corpus keeps no copies above 0.8


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _beside(docs: DataFrame, names: list[str], step) -> DataFrame:
    """``step(docs)`` with the columns of ``docs``, of which those the step would replace are put aside."""
    aside = {c: _unused(docs, c) for c in docs.columns if c in names}
    return step(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, brought in line with the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on labelled ones, does not reject.

    Rows are judged one by one, so equal texts share their fate; a text without words has the
    score of an empty window. Without labels of both classes the share of toxic ones decides.
    """
    spark = prepare(spark)
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    network = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return _beside(docs, ["score", "predicted"], lambda d: toxicity.score(d, network).where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, and of long repeated lines standing alone, leave the texts.

    The first copy by (doc_id, place) stays. Rows without doc_id are compared with nothing; rows
    that repeat a doc_id are one place, so none is the other's copy. Blank lines stay.
    """
    prepare(spark)
    return _sized(_beside(docs, ["n_lines", "n_removed"], lambda d: line_dedup.dedupe(d, long_words=LONG_LINE)))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are linked at NEAR_PERCENT.

    The smallest doc_id stays. Rows equal in doc_id and text are one document; rows without
    doc_id, and further texts of a doc_id, are documents that come after all others, in the order
    of a hash of the row. Texts without words link with nothing and stay.
    """
    prepare(spark)
    key = _unused(docs, "key")
    named = _with_keys(docs, key)
    gone = near_dedup.near_duplicates(named.select(F.col(key).alias("doc_id"), "text"), NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return named.join(gone, key, "left_anti").select(*docs.columns)


def _with_keys(docs: DataFrame, key: str) -> DataFrame:
    """Adds a document key: doc_id where a row has it for itself, a number past all ids otherwise.

    Only rows without doc_id or with a repeated one are grouped, by doc_id and text.
    """
    number, order, first, one = (_unused(docs, n) for n in (key + "n", key + "o", key + "f", key + "r"))
    whole = F.col("doc_id").cast("long")
    repeated = docs.where(whole.isNotNull()).groupBy(whole.alias(number)).agg(F.count(F.lit(1)).alias(one)).where(F.col(one) > 1).select(number)
    repeated = checkpoint(repeated, "repeated")  # mostly empty: as a table its size is known
    marked = docs.withColumn(key, whole)
    plain = marked.where(whole.isNotNull()).join(repeated, whole == F.col(number), "left_anti")
    others = marked.join(repeated, whole == F.col(number), "left_semi").unionByName(marked.where(whole.isNull()))
    hashed = others.withColumn(order, F.xxhash64(*[F.col(c) for c in docs.columns]))
    single = hashed.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns, key, order), F.col(order)).alias(one)).select(f"{one}.*")
    single = checkpoint(single, "documents")  # their hashes are looked at twice
    lowest = single.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(number)).agg(F.min(order).alias(first))
    ranked = single.join(lowest, (F.col(key) == F.col(number)) & (F.col(order) == F.col(first)), "left")
    late = F.lit(1 << 62) + F.shiftright(F.col(order), 2) + F.lit(1 << 61)
    return plain.unionByName(ranked.withColumn(key, F.when(F.col(number).isNull(), late).otherwise(F.col(key))).select(*docs.columns, key))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds leave the texts.

    Rows without doc_id hold nothing for others and lose nothing; rows that repeat a doc_id do
    not lose what they share with each other.
    """
    prepare(spark)
    return _sized(_beside(docs, ["n_words", "n_removed"], substring_dedup.dedupe))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; every row is packed, an empty text as its end mark alone."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: Tokenizing, training and packing have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
