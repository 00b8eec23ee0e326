"""Runs against each other and against reviewed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import ledger
from tallyframe.plans.registry import query, table

BEFORE = "CASE WHEN quality = 1 THEN 'matched' WHEN toxic = 1 THEN 'mismatch' ELSE 'manual' END"
AFTER = "CASE WHEN d.n_chars < 200 THEN 'manual' WHEN quality = 1 THEN 'matched' ELSE 'mismatch' END"
RUNS_SQL = f"""
b AS (SELECT doc_id, {BEFORE} AS decision, CASE WHEN toxic = 1 THEN 'rule' ELSE 'exact' END AS reason FROM labels WHERE NOT (quality = 0 AND toxic = 1)),
c AS (SELECT doc_id, {AFTER} AS decision, CASE WHEN d.lang = 'en' THEN 'exact' ELSE 'rule' END AS reason FROM labels JOIN documents d USING (doc_id)),
g AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'matched' ELSE 'mismatch' END AS expected FROM labels WHERE toxic = 0)
"""


def runs(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    base = labels.where("not (quality = 0 and toxic = 1)").select("doc_id", F.expr(BEFORE).alias("decision"), F.expr("case when toxic = 1 then 'rule' else 'exact' end").alias("reason"))
    now = labels.join(docs, "doc_id").select("doc_id", F.expr(AFTER.replace("d.", "")).alias("decision"), F.expr("case when lang = 'en' then 'exact' else 'rule' end").alias("reason"))
    gold = labels.where("toxic = 0").select("doc_id", F.expr("case when quality = 1 then 'matched' else 'mismatch' end").alias("expected"), F.array().cast("array<string>").alias("acceptable"))
    return base, now, gold


@query(f"""
WITH {RUNS_SQL}
SELECT CASE WHEN b.decision IS NOT DISTINCT FROM c.decision AND b.reason IS DISTINCT FROM c.reason THEN 'reason_only' WHEN b.decision IS NOT DISTINCT FROM c.decision THEN 'unchanged'
  WHEN b.decision IN ('matched', 'mismatch') THEN CASE WHEN c.decision = g.expected THEN 'explained' ELSE 'regression' END
  WHEN b.doc_id IS NULL THEN 'added' WHEN c.doc_id IS NULL THEN 'removed' ELSE 'other' END AS category, count(*) AS n
FROM b FULL JOIN c ON b.doc_id = c.doc_id LEFT JOIN g ON g.doc_id = coalesce(b.doc_id, c.doc_id) GROUP BY 1
""")
def run_diff(spark, sf_dir):
    """Change categories between two runs."""
    base, now, gold = runs(spark, sf_dir)
    return ledger.run_diff(base, now, gold, ["doc_id"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {RUNS_SQL}
SELECT CASE WHEN g.expected IS NOT DISTINCT FROM c.decision THEN 'ok' WHEN g.expected IS NULL THEN 'no_answer' WHEN c.decision IS NULL THEN 'entry_gone'
  WHEN g.expected = 'mismatch' THEN CASE WHEN c.decision = 'manual' THEN 'missed_to_manual' ELSE 'missed' END
  ELSE CASE c.decision WHEN 'mismatch' THEN 'false_alarm' WHEN 'manual' THEN 'extra_manual' ELSE 'scope' END END AS category, count(*) AS n
FROM c FULL JOIN g ON c.doc_id = g.doc_id GROUP BY 1
""")
def gold_check(spark, sf_dir):
    """A run against reviewed answers."""
    _, now, gold = runs(spark, sf_dir)
    both = now.select("doc_id", "decision").join(gold.select("doc_id", "expected"), "doc_id", "full_outer")
    return both.select(ledger.gold_category(F.col("expected"), F.col("decision")).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


ACTION = "CASE event_type WHEN 'signup' THEN 'confirm_candidate' WHEN 'purchase' THEN 'record_observation' WHEN 'error' THEN 'withdraw' ELSE 'mark_source_unreadable' END"


@query(f"""
WITH a AS (SELECT user_id, {ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
SELECT user_id AS finding_id, action, CASE WHEN action = 'confirm_candidate' THEN 'consistent' ELSE 'indeterminate' END AS outcome, CASE WHEN action = 'confirm_candidate' THEN 'warning' ELSE 'manual' END AS status FROM a WHERE k = 1 AND action <> 'withdraw'
""")
def review_state(spark, sf_dir):
    """The effective review of each finding: its latest action, unless that withdraws."""
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("finding_id"), F.col("event_id").alias("revision"), F.expr(ACTION).alias("action"))
    return ledger.effective_reviews(actions)


@query("""
SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
""")
def set_ops(spark, sf_dir):
    """Set and multiset operations on key columns."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    large = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    named = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": lines.subtract(large), "union_all": c.union(s), "intersect_all": c.intersectAll(s), "except_all": c.exceptAll(s)}
    out = None
    for name, df in named.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + n_regionkey) % 25 AS b FROM nation),
w AS (SELECT a AS start, b AS place, 1 AS depth FROM e UNION ALL SELECT w.start, e.b, w.depth + 1 FROM w JOIN e ON w.place = e.a WHERE w.depth < 25 AND w.place <> w.start)
SELECT start, min(depth) FILTER (place = start) AS cycle_length, max(depth) AS walked FROM w GROUP BY 1
""")
def reference_cycles(spark, sf_dir):
    """Cycles among references from nation to nation, by bounded recursion."""
    table(spark, sf_dir, "nation").selectExpr("n_nationkey as a", "(n_nationkey * 3 + n_regionkey) % 25 as b").createOrReplaceTempView("reference_edges")
    return spark.sql("""
        WITH RECURSIVE w AS (SELECT a AS start, b AS place, 1 AS depth FROM reference_edges
          UNION ALL SELECT w.start, e.b, w.depth + 1 FROM w JOIN reference_edges e ON w.place = e.a WHERE w.depth < 25 AND w.place <> w.start)
        SELECT start, min(CASE WHEN place = start THEN depth END) AS cycle_length, max(depth) AS walked FROM w GROUP BY start
    """)
