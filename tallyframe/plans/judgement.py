"""Parsers and verdicts over rendered prose, checked against what was rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import acceptance, clauses, geometry, numbers, status, textdiff
from tallyframe.operators import matching
from tallyframe.plans.registry import query, table


@query("""
SELECT p_type, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 60 <= p_size THEN 'pass' ELSE 'error' END WHEN 1 THEN CASE WHEN (p_partkey % 60) * 1000 >= p_size * 1000 THEN 'pass' ELSE 'error' END
  WHEN 2 THEN CASE WHEN p_partkey % 60 <= p_size THEN 'pass' ELSE 'error' END ELSE 'manual' END AS verdict, count(*) AS n FROM part GROUP BY 1, 2
""")
def acceptance_verdict(spark, sf_dir):
    """Measured values against rendered bounds, deviations after a condition, and unclear prose."""
    n, x = F.col("p_size").cast("string"), (F.col("p_partkey") % 60).cast("string")
    shape = F.col("p_partkey") % 4
    wanted = F.when(shape == 0, F.concat(F.lit("≤"), n, F.lit("mA"))).when(shape == 1, F.concat(F.lit("不小于"), n, F.lit(" mA"))).when(shape == 2, F.concat(F.lit("≤20g 时，误差不超过±"), n, F.lit("g"))).otherwise(F.concat(F.lit("见附录"), n))
    result = F.when(shape == 0, F.concat(x, F.lit(" mA"))).when(shape == 1, F.concat(x, F.lit("000μA"))).when(shape == 2, F.concat(F.lit("+"), x)).otherwise(x)
    return table(spark, sf_dir, "part").select("p_type", acceptance.acceptance(wanted, result).alias("verdict")).groupBy("p_type", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT s_suppkey, s_nationkey || '.' || i AS clause_id, CASE WHEN i = 2 THEN 'excluded' ELSE 'included' END AS decision FROM supplier, (SELECT unnest(range(1, 5)) AS i)
UNION ALL SELECT s_suppkey, s_nationkey || '.9', 'out_of_scope' FROM supplier
""")
def scope_decisions(spark, sf_dir):
    """Scope expressions parsed, and clauses judged: excluded before included before out of scope."""
    stem = F.col("s_nationkey").cast("string")
    shown = F.concat(stem, F.lit(".1～"), stem, F.lit(".4（除"), stem, F.lit(".2外）"))
    scope = table(spark, sf_dir, "supplier").select("s_suppkey", stem.alias("stem"), clauses.parse_scope(shown).alias("scope"))
    asked = scope.select("s_suppkey", "scope", F.explode(F.transform(F.array(*[F.lit(i) for i in (1, 2, 3, 4, 9)]), lambda i: F.concat_ws(".", "stem", i))).alias("clause_id"))
    return asked.select("s_suppkey", "clause_id", clauses.scope_decision(F.col("clause_id"), F.col("scope.included"), F.col("scope.excluded")).alias("decision"))


@query("""
SELECT p_partkey % 3 AS shape, p_partkey % 3 = 0 AS equal, count(*) AS n FROM part GROUP BY 1, 2
""")
def numeric_fact_equality(spark, sf_dir):
    """Numbers with units written in two ways: the same, another scale, another number."""
    n = F.col("p_size").cast("string")
    shape = F.col("p_partkey") % 3
    other = F.when(shape == 0, F.concat(F.lit("≤"), n, F.lit("000μA"))).when(shape == 1, F.concat(F.lit("≤"), n, F.lit("μA"))).otherwise(F.concat(F.lit("≤"), n, F.lit("1mA")))
    rows = table(spark, sf_dir, "part").select(shape.alias("shape"), (textdiff.numeric_facts(F.concat(F.lit("≤"), n, F.lit("mA"))) == textdiff.numeric_facts(other)).alias("equal"))
    return rows.groupBy("shape", "equal").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_suppkey, round(max(CASE WHEN l_returnflag = 'A' THEN l_quantity * 1000 ELSE l_quantity END) / 1000, 6) AS largest FROM lineitem GROUP BY 1
""")
def largest_measurement(spark, sf_dir):
    """The largest of a supplier's measurements in mixed units, in one unit."""
    item = F.struct(F.col("l_quantity").cast("decimal(20,9)").alias("value"), F.when(F.col("l_returnflag") == "A", "mA").otherwise("µA").alias("unit"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(item).alias("items"))
    return rows.select("l_suppkey", F.round(numbers.largest_observation(F.col("items"), F.lit("mA"))["converted"].cast("double"), 6).alias("largest"))


@query("""
WITH p AS (SELECT event_id, user_id % 5 AS page, value AS x, (event_id % 100) * 1.0 AS y FROM events)
SELECT page, CAST(floor(x / 20) AS BIGINT) AS box, count(*) AS n, round(sum(sqrt(pow(greatest(20 * floor(x / 20) + 5 - x, 0, x - (20 * floor(x / 20) + 15)), 2) + pow(greatest(20.0 - y, 0, y - 80), 2))), 4) AS distance FROM p GROUP BY 1, 2
""")
def box_distances(spark, sf_dir):
    """Distances of points to the boxes of their column."""
    k = F.floor(F.col("x") / 20)
    box = F.struct((20.0 * k + 5).alias("x0"), F.lit(20.0).alias("y0"), (20.0 * k + 15).alias("x1"), F.lit(80.0).alias("y1"))
    points = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("page"), F.col("value").alias("x"), ((F.col("event_id") % 100) * 1.0).alias("y"))
    d = geometry.distance(F.struct("x", "y"), box)
    return points.select("page", k.cast("long").alias("box"), d.alias("d")).groupBy("page", "box").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 4).alias("distance"))


@query("""
WITH i AS (SELECT o_custkey AS item, o_orderkey, '见第' || (o_custkey % 50 + 1) || '至' || (o_custkey % 50 + 1 + o_orderkey % 3) AS t FROM orders)
SELECT DISTINCT item, referred FROM (SELECT item, unnest(range(item % 50 + 1, item % 50 + 2 + o_orderkey % 3)) AS referred FROM i)
""")
def reference_expansion(spark, sf_dir):
    """'See items N to M' expanded to the items referred to."""
    first = F.col("o_custkey") % 50 + 1
    shown = F.concat(F.lit("见第"), first.cast("string"), F.lit("至"), (first + F.col("o_orderkey") % 3).cast("string"))
    out = matching.expand_references(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), shown.alias("t")), "item", "t")
    return out.select("item", F.col("referred").cast("long").alias("referred"))


@query("""
WITH r AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN '符合' WHEN 'R' THEN '不符合' ELSE '不适用' END AS s FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(s = '不符合') THEN '不符合' WHEN bool_or(s = '符合') THEN '符合' ELSE '/' END AS conclusion FROM r GROUP BY 1
""")
def status_conclusion(spark, sf_dir):
    """A conclusion from source status words."""
    word = F.when(F.col("l_returnflag") == "A", "符合").when(F.col("l_returnflag") == "R", "不符合").otherwise("不适用")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(word).alias("words"))
    return rows.select("l_orderkey", status.conclusion_of_statuses(F.col("words"), status.STATUS_WORDS).alias("conclusion"))
