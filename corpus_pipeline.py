"""Five stages over the documents table, each with one of the subpackage's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicetopo.llm import minhash, mixing, pieces, pii, queries, toxicity
from slicetopo.llm.common import cut, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    return toxicity.without_toxic(docs, toxicity.usable_labels(table(spark, sf_dir, "labels")))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id. Rows without
    a doc_id stay. Of rows with one doc_id and equal texts the smallest stays; rows with one
    doc_id and different texts all stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice"))
    twice = cut(twice)
    if twice.isEmpty():
        return left
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    again = left.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi")
    # Rows of an id differ at most in columns besides the text: the least as JSON stays.
    first = again.groupBy(F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_text")).agg(F.min_by(own, F.to_json(own)).alias("_row")).select("_row.*")
    return left.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti").unionByName(first)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced."""
    return pii.pseudonymise(docs, queries.surrogate_key(spark), count=None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix of sources takes; taken twice, a row stands twice."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text."""
    return pieces.encode_docs(docs)


STAGES = [("toxicity", toxic_out), ("minhash_near_dedup", one_of_near), ("pii", surrogates), ("mixing", mixture), ("sentencepiece", encoded)]

#: Learned models and a tokenizer's merges have no SQL form; tests hold every stage, and all
#: of them in a row, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
