"""Sources: saved run results, page tables, binary documents and review imports, all with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = (
    "schema_version string, mode string, sample string, findings array<struct<id: string, status: string, details: string>>, "
    "ledger array<struct<entry_id: string, disposition: string, source_row_id: string, target_row_id: string, reason_code: string>>, "
    "coverage struct<source_rows: struct<eligible: long, accounted: long, conserved: boolean>, report_rows: struct<eligible: long, accounted: long, conserved: boolean>>, _corrupt_record string"
)
CELLS = "doc_id string, page int, table_idx int, row_idx int, col_idx int, text string, x0 double, y0 double, x1 double, y1 double"
REVIEW = "finding_id string, decision string, note string, reviewer string"


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved results with their file and a validity class: complete, incomplete or invalid."""
    raw = spark.read.schema(RUN).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    validity = F.when(F.col("_corrupt_record").isNotNull(), "invalid").when(F.col("findings").isNull() | F.col("ledger").isNull() | F.col("coverage").isNull(), "incomplete").otherwise("complete")
    return raw.withColumn("file", F.col("_metadata.file_path")).withColumn("validity", validity)


def with_expected(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (mode, sample) pairs with their run; those without one are 'missing'."""
    return expected.join(runs, ["mode", "sample"], "left").withColumn("validity", F.coalesce("validity", F.lit("missing")))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files by content hash, one row per distinct content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashed = files.select(F.sha2("content", 256).alias("sha256"), "length", "path", "modificationTime")
    return hashed.groupBy("sha256", "length").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Table cells of the extraction layer (Parquet, one row per cell)."""
    return spark.read.schema(CELLS).parquet(path)


def table_rows(cell_rows: DataFrame) -> DataFrame:
    """Cells to rows: the texts of a row in column order, missing columns as ''."""
    keys = ["doc_id", "page", "table_idx", "row_idx"]
    got = cell_rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("m"))
    return got.select(*keys, F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("cells"))


def continuation_columns(cell_rows: DataFrame, template: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Tables without a header whose columns all start where a template's do: (doc_id, page, table_idx, col_idx, title).

    ``template`` has (doc_id, title, x0) of the document's first formal table.
    """
    keys = ["doc_id", "page", "table_idx"]
    starts = cell_rows.groupBy(*keys, "col_idx").agg(F.min("x0").alias("x"))
    t = template.select("doc_id", "title", F.col("x0").alias("tx"))
    near = starts.join(t, (starts.doc_id == t.doc_id) & (F.abs(starts.x - t.tx) <= tolerance)).drop(t.doc_id)
    once = near.groupBy(*keys, "col_idx").agg(F.count(F.lit(1)).alias("n"), F.first("title").alias("title")).where("n = 1").drop("n")
    width = starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"))
    full = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).join(width, keys).where("k = w").select(*keys)
    return once.join(full, keys, "left_semi")


def aligned_cells(cell_rows: DataFrame, header: DataFrame) -> DataFrame:
    """Cells of rows that merged cells shortened, each under the title whose start is nearest."""
    h = header.select("doc_id", "page", "table_idx", F.col("col_idx").alias("__c"), F.col("text").alias("title"), F.col("x0").alias("__x"))
    j = cell_rows.join(h, ["doc_id", "page", "table_idx"])
    keys = ["doc_id", "page", "table_idx", "row_idx", "col_idx", "text"]
    return j.groupBy(*keys).agg(F.min_by("title", F.struct(F.abs(F.col("x0") - F.col("__x")), F.col("__c"))).alias("title"))


def clause_nodes(lines: DataFrame) -> DataFrame:
    """Lines in reading order (doc_id, n, text) to clause nodes: a line that starts with an id opens a node, others continue it."""
    from pyspark.sql.window import Window

    start = r"^\s*([0-9]+(?:\.[0-9]+)+)[\s.、]*(.*)$"
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("is_start", F.col("text").rlike(start)).withColumn("node", F.sum(F.col("is_start").cast("int")).over(w))
    body = F.when(F.col("is_start"), F.regexp_extract("text", start, 2)).otherwise(F.trim("text"))
    grouped = numbered.where("node > 0").groupBy("doc_id", "node").agg(
        F.max(F.when(F.col("is_start"), F.regexp_extract("text", start, 1))).alias("clause_id"),
        F.array_sort(F.collect_list(F.struct("n", body.alias("t")))).alias("l"),
    )
    return grouped.select("doc_id", "node", "clause_id", F.array_join(F.filter(F.transform("l", lambda x: x["t"]), lambda t: t != ""), "\n").alias("text"), (F.size("l") == 1).alias("is_heading_only"))


def review_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW).option("header", True).option("mode", "FAILFAST").csv(path)
