"""Results that several later steps read, computed once and kept in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the folder of spark.checkpoint.dir (on a local master without one: a temporary folder)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        sc.setCheckpointDir(named)
    return df.checkpoint()
