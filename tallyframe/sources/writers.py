"""Sinks. A result is validated before anything is written; a marker row makes it visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.status import STATUS_RANK, rank_of
from tallyframe.operators.ledger import require_coverage

PUBLISHED = "run_id string, ledger_rows long, finding_rows long"


def publish(run_id: str, ledger: DataFrame, findings: DataFrame, source: DataFrame, target: DataFrame, path: str) -> None:
    """Ledger and findings as Parquet below ``path``, then the commit marker; raises without writing if rows aren't conserved."""
    require_coverage(source, target, ledger)
    wrong = findings.groupBy("finding_id").count().where("count > 1").limit(1).count()
    if wrong:
        raise ValueError("finding ids repeat")
    ledger.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/ledger")
    findings.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/findings")
    spark = ledger.sparkSession
    marker = spark.createDataFrame([(run_id, ledger.count(), findings.count())], PUBLISHED)
    marker.coalesce(1).write.mode("append").parquet(f"{path}/published")


def published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of committed runs only."""
    done = spark.read.schema(PUBLISHED).parquet(f"{path}/published").select("run_id").distinct()
    return spark.read.parquet(f"{path}/{table}").withColumn("run_id", F.col("run_id").cast("string")).join(done, "run_id", "left_semi")


def display_order(findings: DataFrame, plan: DataFrame) -> DataFrame:
    """Display sequence within each run: worst status, then the rule's place in the plan, then id."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("run_id").orderBy(F.desc(rank_of(F.col("status"), STATUS_RANK)), "plan_order", "finding_id")
    return findings.join(plan, "rule_id", "left").withColumn("display_sequence", F.row_number().over(order))


def append_new_blobs(blobs: DataFrame, store: DataFrame) -> DataFrame:
    """Contents that the store doesn't hold."""
    return blobs.join(store.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])


def review_csv(rows: DataFrame, path: str) -> None:
    """Flat CSV with a header; nested columns as JSON text."""
    nested = [c for c, t in rows.dtypes if t.startswith(("array", "struct", "map"))]
    rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)


def result_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and content hash of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
