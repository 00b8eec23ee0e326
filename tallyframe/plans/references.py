"""Items that point to others, clauses that moved, scopes that stay open, and conclusions of whole items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import status
from tallyframe.operators import references
from tallyframe.plans.registry import query, table


@query("""
SELECT s_suppkey AS item, CASE WHEN s_suppkey % 4 = 3 AND s_suppkey % 3 = 0 THEN '符合' WHEN s_suppkey % 4 = 3 THEN '不符合' WHEN s_suppkey % 20 = 0 THEN NULL ELSE '不符合' END AS derived FROM supplier WHERE s_suppkey % 4 IN (0, 3) AND s_suppkey > 0
""")
def referred_conclusions(spark, sf_dir):
    """Conclusions of items whose results only say 'see item N', 'N under C', or 'N to M'; null where that can't be followed."""
    s = F.col("s_suppkey")
    at = lambda d: (s + d).cast("string")
    single = F.when(s % 3 == 0, F.concat(F.lit("见序号"), at(-2), F.lit("中20.1"))).otherwise(F.concat(F.lit("见序号"), at(-1)))
    span = F.concat(F.lit("见序号"), at(-3), F.lit("～序号"), F.when(s % 20 == 0, at(600)).otherwise(at(-1)))
    result = F.when(s % 4 == 1, "符合要求").when(s % 4 == 2, "不符合要求").when(s % 4 == 3, single).otherwise(span)
    items = table(spark, sf_dir, "supplier").where(s > 0).select(s.alias("item"), F.lit("20.1 外观").alias("requirement"), result.alias("result"), F.when(s % 8 == 2, "不符合").alias("conclusion"))
    return references.referred_conclusions(items)


@query("""
WITH d AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_nationkey, '2' AS up, 1 AS "offset", CAST(min(r) AS INTEGER) AS "first", CAST(max(r) AS INTEGER) AS "last", count(*) AS length FROM d WHERE r >= 2 AND r < n GROUP BY 1
""")
def clause_shifts(spark, sf_dir):
    """A clause is left out and the rest renumbered: runs of clauses whose title belongs to the next number."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    title = F.concat(F.lit("T"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    d = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("2."), F.row_number().over(w).cast("string")).alias("clause"), title.alias("title"), F.lead(title).over(w).alias("next"))
    kept = F.col("clause") == "2.1"
    printed = d.select("s_nationkey", "clause", F.when(kept, F.col("title")).otherwise(F.col("next")).alias("title")).where("title is not null")
    return references.shift_runs(references.moved_clauses(d, printed, keys=["s_nationkey"]), ["s_nationkey"])


@query("""
SELECT DISTINCT o.o_custkey, CAST(o.o_custkey % 9 AS VARCHAR) || '.' || k AS clause FROM orders o, (VALUES (1), (2), (3)) v(k)
WHERE NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderkey % 5 + 1 = k)
""")
def scope_holes(spark, sf_dir):
    """Declared clauses without a covered clause at or below them."""
    stem = (F.col("o_custkey") % 9).cast("string")
    orders = table(spark, sf_dir, "orders")
    declared = orders.select("o_custkey", stem.alias("stem")).distinct().select("o_custkey", F.explode(F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.concat_ws(".", "stem", k))).alias("clause"))
    covered = orders.select("o_custkey", F.concat(stem, F.lit("."), (F.col("o_orderkey") % 5 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".4 a)").otherwise("")).alias("clause"))
    return references.scope_holes(declared, covered, keys=["o_custkey"])


@query("""
SELECT l_orderkey, l_linenumber % 2 AS page, count(*) FILTER (l_returnflag = 'A') AS filled, count(*) FILTER (l_returnflag <> 'A') AS blank FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag <> 'A') > 0
""")
def partial_conclusion_cells(spark, sf_dir):
    """Conclusion cells that cover only part of an item's rows on a page."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("page"), F.when(F.col("l_returnflag") == "A", "符合").otherwise(" ").alias("text"))
    return references.conclusion_cells(cells, "l_orderkey", "page", "text")


@query("""
WITH g AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS bad, bool_or(l_returnflag = 'N') AS unread, bool_or(l_returnflag = 'N' AND l_linestatus = 'F') AS blank FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN blank THEN 'mismatch' WHEN NOT bad AND unread THEN 'manual' WHEN l_orderkey % 7 = 0 THEN 'manual' WHEN bad = (l_orderkey % 2 = 0) THEN 'match' ELSE 'mismatch' END AS decision,
  CASE WHEN blank THEN 'record_status_blank' WHEN NOT bad AND unread THEN 'record_sequence_status_unresolved' WHEN l_orderkey % 7 = 0 THEN 'report_sequence_result_missing' WHEN bad = (l_orderkey % 2 = 0) THEN 'sequence_result_matched' ELSE 'sequence_result_mismatch' END AS reason FROM g
""")
def item_conclusion_check(spark, sf_dir):
    """Source statuses of an item against the conclusion that its results give."""
    flag = F.col("l_returnflag")
    word = F.when(flag == "R", "不符合").when(flag == "A", "符合")
    reason = F.when((flag == "N") & (F.col("l_linestatus") == "F"), "status_box_blank").otherwise("")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(word.alias("s"))).alias("statuses"), F.collect_set(reason).alias("reasons"))
    known = F.transform("statuses", lambda x: x["s"])
    wanted = F.when(F.array_contains(known, "不符合"), "不符合").otherwise(status.conclusion_of_statuses(known, status.STATUS_WORDS))
    observed = F.when(F.col("l_orderkey") % 2 == 0, "不符合").otherwise("符合")
    out = references.sequence_conclusion(known, F.col("reasons"), wanted, observed, F.col("l_orderkey") % 7 == 0)
    return rows.select("l_orderkey", out["decision"].alias("decision"), out["reason"].alias("reason"))
