"""The queries of the operators in this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bloom_lm, boosted_toxicity, line_crf, ngram_join, packing, piece_counts, raking, spaced_seeds, store, suffix_dedup, warc

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raking.mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(
        "doc_id",
        F.col("__0").alias("source"),
        F.col("__1").alias("lang"),
        F.col("__2").alias("topic"),
        F.col("__n").alias("n_tokens"),
        F.round("__f", 6).alias("factor"),
        F.round("__p", 6).alias("probability"),
        F.col("__keep").alias("kept"),
    )


def op4_tokens(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents"), piece_counts.load_vocabulary(pieces))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def shards(docs: DataFrame) -> DataFrame:
    out = packing.shard_documents(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), store.work_dir(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_ngram_join, op2_quality, op3_mixing, op4_tokens, op5_decontamination, op6_sharding, op7_warc, op8_suffix_dedup, op9_lm_scoring, op10_toxicity)
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": raking.oracle_sql()}
