"""Where lineage is cut: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = str(8 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master a temporary one if it is unset."""
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir()
    if set_dir is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        sc.setCheckpointDir(named)
        set_dir = sc.getCheckpointDir()
    return set_dir


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, not only by rows: 10,000 rows of long texts or sets are hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once, written to the shared folder as a table and read back."""
    bound_batches(df.sparkSession)
    path = work_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
