"""Ordinary analytics over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.plans.registry import query, table


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, sf_dir):
    """Sums and means of lines shipped by a date."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    price = F.col("l_extendedprice")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def local_revenue(spark, sf_dir):
    """Revenue of suppliers with customers of their own nation."""
    t = lambda name: table(spark, sf_dir, name)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS moving, ntile(4) OVER w AS quarter, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), 6) AS share
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def window_frames(spark, sf_dir):
    """Running sums, moving means, quartiles and ranks within a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))
    moving = F.avg("o_totalprice").over(w.rowsBetween(-2, 0))
    rank = F.percent_rank().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(running, 2).alias("running"), F.round(moving, 3).alias("moving"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(rank, 6).alias("share"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, sf_dir):
    """The hundred largest orders (a top-k report)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""
SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O') GROUP BY 1
""")
def semi_and_anti(spark, sf_dir):
    """Orders with a returned line and no open one."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = table(spark, sf_dir, "orders").join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(lines.where("l_linestatus = 'O'"), "o_orderkey", "left_anti")
    return out.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1
""")
def pivot_segments(spark, sf_dir):
    """Segments as columns."""
    out = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))
    return out.select("c_nationkey", *[F.coalesce(s, F.lit(0)).cast("long").alias(s.lower()) for s in ("AUTOMOBILE", "BUILDING", "MACHINERY")])
