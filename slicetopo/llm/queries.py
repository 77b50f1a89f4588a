"""The operators' registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, language, minhash, mixing, pieces, pii, rules, sharding, substrings, toxicity, variants, vectors
from .common import table
from .oracles import ORACLES


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_docs(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.fold_of(F.col("doc_id"), 4) == 2
    model = language.train(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "mixture")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score_toxicity(docs, toxicity.usable_labels(labels))
    return out.select("doc_id", (toxicity.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "spans")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.windows(turns.unionByName(more)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), "doc_id")


def surrogate_key(spark: SparkSession) -> str:
    """The session's key; without one a key that is good for test tables only."""
    return spark.conf.get("spark.slicetopo.surrogateKey", "for test tables only")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.balance(docs, sharding.equal_text(docs)).drop("link")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.without_repeats(table(spark, sf_dir, "documents")))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language, op3_toxicity, op4_vectors, op5_minhash, op6_chat, op7_mixing, op8_rules, op9_pii, op10_sharding, op11_variants, op12_substrings, op13_codes)}

__all__ = ["ORACLES", "QUERIES"]
