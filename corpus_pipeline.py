"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage works on all rows that its predecessor kept. ``run`` writes each stage's
rows to the shared folder as Parquet and reads them back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import boosted_toxicity, ngram_join, queries, raking, spaced_seeds, store
from tallyframe.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below 0.3."""
    ship(spark)
    return boosted_toxicity.drop_toxic(docs, queries.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    ship(spark)
    return ngram_join.keep_one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return spaced_seeds.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the raked probabilities of source, language and topic."""
    names = raking.names_for(docs)
    return raking.mix_sources(docs, names=names).where(names.keep).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document left."""
    return queries.shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Trees, similarity search and packing aren't expressible in SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store.cut(stage(spark, docs, sf_dir))
    return docs
