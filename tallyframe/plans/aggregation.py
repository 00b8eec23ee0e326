"""Rollups, agreement, fingerprints and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.status import STATUS_RANK, conclusion_of_results, worst
from tallyframe.plans.reconciliation import STATUS_SQL, status_ledger
from tallyframe.plans.registry import query, table


@query("""
SELECT c_mktsegment, CASE max(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' WHEN 2 THEN 'manual' ELSE 'error' END AS status, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, c_nationkey
""")
def severity_rollup(spark, sf_dir):
    """Worst status of each segment and nation."""
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_totalprice") < 100000, "warning").when(F.col("o_orderstatus") == "P", "manual").otherwise("error")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", "c_nationkey").agg(worst(status, STATUS_RANK).alias("status"), F.count(F.lit(1)).alias("n")).drop("c_nationkey")


@query("""
WITH l AS (SELECT DISTINCT source, doc_id, trim(line) AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
d AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)
SELECT source, line, count(*) AS n FROM l JOIN d USING (source) GROUP BY source, line, docs HAVING count(*) >= greatest(3, ceil(docs * 0.1))
""")
def running_headers(spark, sf_dir):
    """Lines that stand on a tenth of a source's documents."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("source", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    counts = lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(total, "source").where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("docs") * 0.1))).select("source", "line", "n")


@query("""
WITH c AS (SELECT d.doc_id, l.quality AS a, CASE WHEN d.n_chars >= 60 THEN 1 ELSE 0 END AS b, CASE WHEN contains(d.text, '###') OR contains(d.text, '!!') THEN 0 ELSE 1 END AS e FROM labels l JOIN documents d USING (doc_id)),
v AS (SELECT doc_id, unnest([a, b, e]) AS value FROM c), s AS (SELECT doc_id, value, count(*) AS support FROM v GROUP BY 1, 2)
SELECT doc_id, CASE WHEN count(*) = 1 THEN min(value) END AS accepted, max(support) AS support FROM s WHERE support >= 2 GROUP BY 1
""")
def channel_agreement(spark, sf_dir):
    """The one value that at least two of three channels give."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    long = (F.col("n_chars") >= 60).cast("int")
    plain = (~(F.contains("text", F.lit("###")) | F.contains("text", F.lit("!!")))).cast("int")
    votes = d.select("doc_id", F.explode(F.array("quality", long, plain)).alias("value"))
    support = votes.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("support")).where("support >= 2")
    return support.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("value")).alias("accepted"), F.max("support").alias("support"))


@query("""
WITH v AS (SELECT d.doc_id, l.quality, CASE WHEN d.n_chars >= 60 THEN 1 ELSE 0 END AS derived FROM labels l JOIN documents d USING (doc_id))
SELECT quality, derived, count(*) AS n, CASE WHEN quality = derived THEN 'accepted' ELSE 'manual' END AS verdict FROM v GROUP BY 1, 2
""")
def two_channel_agreement(spark, sf_dir):
    """A label against a derived one: accepted where both agree."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", (F.col("n_chars") >= 60).cast("int").alias("derived"))
    return d.groupBy("quality", "derived").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.when(F.col("quality") == F.col("derived"), "accepted").otherwise("manual"))


@query("""
WITH f AS (SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || lower(regexp_replace(text, '\\s+', '', 'g')), '|' ORDER BY turn, role, text)) AS fingerprint FROM conversations GROUP BY 1)
SELECT fingerprint, min(conv_id) AS first_id, count(*) AS copies, max(turns) AS turns FROM f GROUP BY 1
""")
def table_fingerprint(spark, sf_dir):
    """Conversations by the hash of their ordered, normalised rows."""
    row = F.concat("role", F.lit(":"), F.lower(F.regexp_replace("text", r"\s+", "")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", row.alias("r")))).alias("rows"))
    keyed = rows.select("conv_id", F.size("rows").cast("long").alias("turns"), F.md5(F.array_join(F.transform("rows", lambda x: x["r"]), "|")).alias("fingerprint"))
    return keyed.groupBy("fingerprint").agg(F.min("conv_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("turns").alias("turns"))


@query("SELECT md5(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    """Documents with equal texts."""
    out = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.array_sort(F.collect_list("doc_id")).alias("l"))
    return out.where("copies > 1").select("fingerprint", "copies", "first_id", F.array_join(F.col("l").cast("array<string>"), ",").alias("ids"))


@query(f"""
WITH l AS ({STATUS_SQL})
SELECT order_status, disposition, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS lines, CAST(grouping(order_status, disposition) AS INTEGER) AS level FROM l GROUP BY GROUPING SETS ((order_status, disposition), (order_status), ())
""")
def grouping_sets_overview(spark, sf_dir):
    """Ledger counts by status and disposition with subtotals."""
    out = status_ledger(spark, sf_dir).rollup("order_status", "disposition")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("line_count").alias("lines"), F.grouping_id("order_status", "disposition").cast("int").alias("level"))


@query("""
SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean, CAST(grouping(c_mktsegment, o_orderpriority) AS INTEGER) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)
""")
def cube_overview(spark, sf_dir):
    """Orders by segment and priority, in all groupings."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.cube("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.grouping_id().cast("int").alias("level"))


@query(f"""
WITH l AS ({STATUS_SQL})
SELECT order_status, count(*) FILTER (disposition = 'matched') AS matched, count(*) FILTER (disposition = 'mismatch') AS mismatch, count(*) FILTER (disposition = 'manual') AS manual, count(*) FILTER (disposition = 'source_only') AS source_only,
  CASE WHEN count(*) FILTER (disposition = 'mismatch') > 0 THEN 'error' WHEN count(*) FILTER (disposition IN ('manual', 'source_only', 'target_only')) > 0 THEN 'manual' ELSE 'pass' END AS overall
FROM l GROUP BY 1
""")
def ledger_status_counts(spark, sf_dir):
    """Dispositions as columns, and the overall status they give."""
    names = ("matched", "mismatch", "manual", "source_only")
    counts = [F.count_if(F.col("disposition") == d).alias(d) for d in names]
    out = status_ledger(spark, sf_dir).groupBy("order_status").agg(*counts, F.count_if(F.col("disposition").isin("manual", "source_only", "target_only")).alias("open"))
    return out.withColumn("overall", F.when(F.col("mismatch") > 0, "error").when(F.col("open") > 0, "manual").otherwise("pass")).drop("open")


RESULT = "CASE WHEN l_returnflag = 'R' THEN '不符合要求' WHEN l_linestatus = 'O' THEN '/' WHEN l_quantity < 5 THEN '——' ELSE '符合要求' END"


@query(f"""
WITH r AS (SELECT l_orderkey, {RESULT} AS result FROM lineitem)
SELECT o_orderkey, CASE WHEN count(result) = 0 THEN '<missing>' WHEN bool_or(result = '不符合要求') THEN '不符合' WHEN bool_or(result NOT IN ('——', '/')) THEN '符合' ELSE '/' END AS conclusion
FROM orders LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1
""")
def item_conclusion(spark, sf_dir):
    """An item's conclusion from its results: one nonconforming decides, placeholders alone give '/'."""
    results = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(RESULT).alias("result")).groupBy("l_orderkey").agg(F.collect_set("result").alias("results"))
    items = table(spark, sf_dir, "orders").join(results, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return items.select("o_orderkey", conclusion_of_results(F.coalesce("results", F.array().cast("array<string>"))).alias("conclusion"))


@query("""
WITH s AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT coalesce(s.k, t.k) AS nation_key, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows, CASE WHEN t.n IS NULL THEN 'missing' WHEN s.n IS NULL THEN 'extra' WHEN s.n = t.n THEN 'equal' ELSE 'different' END AS drift FROM s FULL JOIN t ON s.k = t.k
""")
def inventory_drift(spark, sf_dir):
    """Row counts of two inventories by key."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation_key")).agg(F.count(F.lit(1)).alias("a"))
    t = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.count(F.lit(1)).alias("b"))
    drift = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "equal").otherwise("different")
    return s.join(t, "nation_key", "full_outer").select("nation_key", F.coalesce("a", F.lit(0)).alias("source_rows"), F.coalesce("b", F.lit(0)).alias("target_rows"), drift.alias("drift"))


@query("""
SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS median, round(stddev_samp(p_retailprice), 4) AS deviation, count(DISTINCT p_type) AS types, mode_count FROM part JOIN (SELECT p_brand, max(n) AS mode_count FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1) USING (p_brand) GROUP BY p_brand, mode_count
""")
def distribution_summary(spark, sf_dir):
    """Median, deviation, distinct values and highest frequency."""
    part = table(spark, sf_dir, "part")
    modes = part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).groupBy("p_brand").agg(F.max("n").alias("mode_count"))
    out = part.groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("median"), F.round(F.stddev_samp("p_retailprice"), 4).alias("deviation"), F.count_distinct("p_type").alias("types"))
    return out.join(modes, "p_brand")
