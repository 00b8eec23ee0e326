"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import clauses
from tallyframe.functions.status import STATUS_RANK, rank_of
from tallyframe.operators import sequences
from tallyframe.plans.reconciliation import CLAUSE_SQL, clause_rows
from tallyframe.plans.registry import query, table


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_id FROM events
""")
def fill_down_sessions(spark, sf_dir):
    """The last signup so far of each user's events."""
    events = table(spark, sf_dir, "events").withColumn("session_id", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return sequences.fill_down(events, ["user_id"], ["ts", "event_id"], ["session_id"]).select("event_id", "session_id")


@query("""
WITH m AS (SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, list(DISTINCT l_linenumber) AS have FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT m.l_orderkey, first, last, array_to_string(list_filter(range(1, last + 1), lambda x: NOT list_contains(have, CAST(x AS INTEGER))), ',') AS missing, coalesce(r.n, 0) AS n_repeated FROM m LEFT JOIN r USING (l_orderkey)
""")
def sequence_gaps(spark, sf_dir):
    """Line numbers that an order lacks in 1..max, and how many it repeats."""
    out = sequences.gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", "first", "last", F.array_join("missing", ",").alias("missing"), F.size("repeated").cast("long").alias("n_repeated"))


@query("""
WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS length FROM g GROUP BY user_id, island HAVING count(*) >= 3
""")
def consecutive_runs(spark, sf_dir):
    """Three or more consecutive days with events of a user."""
    days = table(spark, sf_dir, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    return sequences.islands(days, ["user_id"], "day").where("length >= 3")


@query("""
WITH d AS (SELECT DISTINCT l_suppkey, l_linenumber AS n FROM lineitem WHERE l_quantity > 48), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS i FROM d),
r AS (SELECT l_suppkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_suppkey, i)
SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY 1
""")
def page_ranges(spark, sf_dir):
    """Numbers collapsed to '1-3,5'."""
    return sequences.range_text(table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_suppkey", F.col("l_linenumber").alias("n")), "l_suppkey", "n")


@query("""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS k FROM lineitem)
SELECT l_orderkey || '-' || l_linenumber || CASE WHEN n > 1 THEN '#' || k ELSE '' END AS key, l_partkey FROM r
""")
def occurrence_keys(spark, sf_dir):
    """Keys of lines, numbered where they repeat."""
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return sequences.occurrence_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("key", "l_partkey")


EVENT_STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'manual' WHEN 'view' THEN 'pass' ELSE 'warning' END"


@query(f"""
WITH f AS (SELECT event_id, user_id, {EVENT_STATUS} AS status FROM events)
SELECT event_id, status, row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'manual' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, event_id) AS display_sequence FROM f
""")
def display_sequence(spark, sf_dir):
    """Findings of a run in display order: worst first, then id."""
    from pyspark.sql.window import Window

    f = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(EVENT_STATUS).alias("status"))
    w = Window.partitionBy("user_id").orderBy(F.desc(rank_of(F.col("status"), STATUS_RANK)), "event_id")
    return f.select("event_id", "status", F.row_number().over(w).cast("long").alias("display_sequence"))


@query("""
SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1
""")
def latest_per_key(spark, sf_dir):
    """The latest event of each user and type, by one aggregation."""
    out = sequences.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@query(f"SELECT c_custkey, clause_id, row_number() OVER (ORDER BY list_transform(regexp_extract_all(clause_id, '[0-9]+'), lambda x: CAST(x AS INTEGER)), regexp_extract(clause_id, '[a-z]'), c_custkey) AS place FROM {CLAUSE_SQL}")
def natural_clause_order(spark, sf_dir):
    """Place of each clause in natural order (2.10 after 2.9): a range sort, and counts per sorted part.

    A single window over all rows would run in one task; here a row's place is its
    number within its top clause plus the rows of the top clauses before it.
    """
    from pyspark.sql.window import Window

    rows = clause_rows(spark, sf_dir)[0].withColumn("p", clauses.path(F.col("clause_id"))).withColumn("top", F.try_element_at("p", F.lit(1)))
    starts = rows.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
    before = starts.select("top", F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("top").orderBy("p", clauses.letter(F.col("clause_id")), "c_custkey")
    return rows.join(F.broadcast(before), "top").select("c_custkey", "clause_id", (F.col("before") + F.row_number().over(w)).alias("place"))


@query("""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5
""")
def spot_check_quota(spark, sf_dir):
    """Five documents of each source by a seeded hash."""
    return sequences.spot_checks(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5, "7")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, lead(n) OVER w AS runner_up, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY n DESC, p_type))
SELECT p_brand, p_type, n, runner_up, runner_up IS NULL OR n >= 1.35 * runner_up AS clear FROM r WHERE k = 1
""")
def topk_margin(spark, sf_dir):
    """The commonest type of each brand, and whether it leads by 1.35."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return sequences.best_with_margin(counts, "p_brand", "n", "p_type", 1.35)


@query("""
WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT coalesce(previous, '<start>') AS previous, event_type, count(*) AS n,
  CASE WHEN previous IS NULL THEN event_type = 'signup' WHEN previous = 'signup' THEN event_type IN ('view', 'click') WHEN previous = 'view' THEN event_type IN ('view', 'click', 'error')
       WHEN previous = 'click' THEN event_type IN ('view', 'purchase', 'error') WHEN previous = 'purchase' THEN event_type IN ('view') ELSE event_type = 'view' END AS allowed
FROM s GROUP BY 1, 2, previous
""")
def lifecycle_transitions(spark, sf_dir):
    """Steps of each user's events against a table of allowed transitions."""
    from tallyframe.functions.status import transition_ok

    machine = {"signup": ["view", "click"], "view": ["view", "click", "error"], "click": ["view", "purchase", "error"], "purchase": ["view"], "error": ["view"]}
    steps = sequences.state_steps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    out = steps.groupBy("previous", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("previous", F.lit("<start>")).alias("previous"), "event_type", "n", transition_ok(F.col("previous"), F.col("event_type"), machine, "signup").alias("allowed"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
g AS (SELECT *, coalesce(day - lag(day) OVER w > 60, true) AS fresh FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
l AS (SELECT o_custkey, day, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY day ROWS UNBOUNDED PRECEDING) AS line FROM g)
SELECT o_custkey, CAST(line AS BIGINT) AS line, min(day) AS low, max(day) AS high, count(*) AS n FROM l GROUP BY 1, 2
""")
def gap_clusters(spark, sf_dir):
    """Order days of a customer in runs; a gap of over 60 days starts a new one."""
    days = table(spark, sf_dir, "orders").select("o_custkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    rows = sequences.row_lines(days, ["o_custkey"], "day", 60)
    return rows.groupBy("o_custkey", "line").agg(F.min("day").alias("low"), F.max("day").alias("high"), F.count(F.lit(1)).alias("n"))
