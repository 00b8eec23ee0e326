"""Queries that match two sides."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyframe.functions import clauses, textdiff
from tallyframe.operators import ledger, matching
from tallyframe.plans.registry import query, table

STATUS_SQL = """
WITH t AS (SELECT l_orderkey AS k, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS one, count(*) AS line_count FROM lineitem GROUP BY 1)
SELECT coalesce(o.o_orderkey, t.k) AS order_key, o.o_orderstatus AS order_status, coalesce(t.line_count, 0) AS line_count,
  CASE WHEN t.k IS NULL THEN 'source_only' WHEN o.o_orderkey IS NULL THEN 'target_only'
       WHEN t.n > 1 THEN CASE WHEN o.o_orderstatus = 'P' THEN 'matched' ELSE 'manual' END
       WHEN t.one = o.o_orderstatus THEN 'matched' ELSE 'mismatch' END AS disposition
FROM orders o FULL JOIN t ON o.o_orderkey = t.k
"""


def status_ledger(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("order_status"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key"))
    lines = lines.agg(F.min("l_linestatus").alias("low"), F.max("l_linestatus").alias("high"), F.count(F.lit(1)).alias("line_count"))

    def judge():
        several = F.col("t.low") != F.col("t.high")
        return F.when(several, F.when(F.col("s.order_status") == "P", "matched").otherwise("manual")).when(F.col("t.low") == F.col("s.order_status"), "matched").otherwise("mismatch")

    out = matching.reconcile(orders, lines, ["order_key"], judge)
    return out.select("order_key", F.col("s.order_status").alias("order_status"), F.coalesce("t.line_count", F.lit(0)).alias("line_count"), "disposition")


@query(STATUS_SQL)
def reconcile_status(spark, sf_dir):
    """Order status against the statuses of its lines: full outer, three-valued."""
    return status_ledger(spark, sf_dir)


@query("""
WITH t AS (SELECT l_orderkey AS k, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS total FROM lineitem GROUP BY 1)
SELECT CASE WHEN t.k IS NULL THEN 'source_only' WHEN o.o_orderkey IS NULL THEN 'target_only'
  WHEN abs(t.total - o.o_totalprice) < 0.005 THEN 'matched' ELSE 'mismatch' END AS disposition, count(*) AS n
FROM orders o FULL JOIN t ON o.o_orderkey = t.k GROUP BY 1
""")
def reconcile_amount(spark, sf_dir):
    """Order totals against the sums of their lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(amount), 2).alias("total"))
    out = matching.reconcile(orders, lines, ["k"], lambda: F.when(F.abs(F.col("t.total") - F.col("s.price")) < 0.005, "matched").otherwise("mismatch"))
    return out.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH ledger AS ({STATUS_SQL}), e AS (SELECT 'source' AS side, o_orderkey AS k FROM orders UNION ALL SELECT 'target', k FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem)),
s AS (SELECT 'source' AS side, order_key AS k FROM ledger WHERE disposition <> 'target_only' UNION ALL SELECT 'target', order_key FROM ledger WHERE disposition <> 'source_only')
SELECT side, count(e.k) AS eligible, count(s.k) FILTER (e.k IS NOT NULL) AS accounted, count(*) FILTER (s.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS unknown,
  count(e.k) = count(s.k) AND count(*) FILTER (s.k IS NULL OR e.k IS NULL) = 0 AS conserved
FROM e FULL JOIN s USING (side, k) GROUP BY side
""")
def coverage_conservation(spark, sf_dir):
    """Eligible and accounted rows of both sides of the status ledger."""
    found = status_ledger(spark, sf_dir)
    source = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"))
    target = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key")).distinct()
    rows = [
        ledger.coverage(eligible, found.where(F.col("disposition") != other), "order_key").select(F.lit(side).alias("side"), "*")
        for side, eligible, other in (("source", source, "target_only"), ("target", target, "source_only"))
    ]
    return rows[0].unionByName(rows[1]).drop("repeated")


@query("""
WITH e AS (SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND round(s_acctbal / 100) = round(c_acctbal / 100)),
d AS (SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS a, count(*) OVER (PARTITION BY c_custkey) AS b FROM e)
SELECT s_suppkey, c_custkey FROM d WHERE a = 1 AND b = 1
""")
def mutual_unique_pairs(spark, sf_dir):
    """Supplier and customer of one nation and balance band that have no other such partner."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    on = (s.s_nationkey == c.c_nationkey) & (F.round(s.s_acctbal / 100) == F.round(c.c_acctbal / 100))
    return matching.mutually_unique(matching.candidate_edges(s, c, on, "s_suppkey", "c_custkey"), "s_suppkey", "c_custkey")


CLAUSE_SQL = "(SELECT c_custkey, n_regionkey || '.' || c_nationkey || '.' || (c_custkey % 7) || CASE WHEN c_custkey % 3 = 0 THEN chr(CAST(97 + c_custkey % 4 AS INTEGER)) ELSE '' END AS clause_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SCOPE_SQL = "(SELECT DISTINCT n_regionkey || '.' || n_nationkey AS scope_id FROM nation WHERE n_name < 'J' UNION SELECT n_regionkey || '.' || n_nationkey || '.2' FROM nation)"


def clause_rows(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    letter = F.when(F.col("c_custkey") % 3 == 0, F.char(97 + F.col("c_custkey") % 4)).otherwise("")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.concat(F.concat_ws(".", "n_regionkey", "c_nationkey", F.col("c_custkey") % 7), letter).alias("clause_id"))
    whole = nation.where("n_name < 'J'").select(F.concat_ws(".", "n_regionkey", "n_nationkey").alias("scope_id"))
    return rows, whole.unionByName(nation.select(F.concat(F.concat_ws(".", "n_regionkey", "n_nationkey"), F.lit(".2")).alias("scope_id"))).distinct()


def in_scope(spark, sf_dir, how):
    """Descendants by equality on the clause's own prefixes: no theta join."""
    rows, scope = clause_rows(spark, sf_dir)
    ups = F.concat(F.array(clauses.canonical(F.col("clause_id"))), clauses.ancestors(F.col("clause_id")))
    hit = rows.select("c_custkey", F.explode(ups).alias("scope_id")).join(scope, "scope_id", "left_semi").select("c_custkey").distinct()
    return rows.join(hit, "c_custkey", how)


WITHIN = "(c.clause_id = s.scope_id OR starts_with(c.clause_id, s.scope_id || '.') OR regexp_full_match(c.clause_id, s.scope_id || '[a-z]'))"


@query(f"SELECT * FROM {CLAUSE_SQL} c WHERE EXISTS (SELECT 1 FROM {SCOPE_SQL} s WHERE {WITHIN})")
def clause_scope_semi(spark, sf_dir):
    """Clauses that lie in a declared scope."""
    return in_scope(spark, sf_dir, "left_semi")


@query(f"SELECT * FROM {CLAUSE_SQL} c WHERE NOT EXISTS (SELECT 1 FROM {SCOPE_SQL} s WHERE {WITHIN})")
def clause_scope_anti(spark, sf_dir):
    """Clauses outside of every declared scope."""
    return in_scope(spark, sf_dir, "left_anti")


@query(f"""
SELECT c.c_custkey, c.clause_id, arg_max(s.scope_id, length(s.scope_id)) AS scope_id
FROM {CLAUSE_SQL} c LEFT JOIN {SCOPE_SQL} s ON c.clause_id = s.scope_id OR starts_with(c.clause_id, s.scope_id || '.') GROUP BY 1, 2
""")
def longest_prefix_assign(spark, sf_dir):
    """Each clause with the longest scope that is a dotted prefix of it."""
    rows, scope = clause_rows(spark, sf_dir)
    return matching.longest_prefix(rows, "clause_id", scope, "scope_id")


@query("""
SELECT e.event_id, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS asof_signup_ts
FROM events e WHERE e.event_type = 'purchase'
""")
def asof_version(spark, sf_dir):
    """Each purchase with the user's last signup at or before it."""
    events = table(spark, sf_dir, "events")
    signups = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"))
    out = matching.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", "signup_ts", "signup_ts")
    return out.select("event_id", "asof_signup_ts")


@query("""
WITH b AS (SELECT i AS band, 900.0 + 37 * i AS low, 900.0 + 37 * i + 50 AS high FROM range(0, 35) r(i))
SELECT band, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part JOIN b ON p_retailprice >= low AND p_retailprice < high GROUP BY 1
""")
def range_join_bands(spark, sf_dir):
    """Parts in overlapping price bands."""
    bands = spark.range(35).select(F.col("id").alias("band"), (900.0 + 37 * F.col("id")).alias("low"), (950.0 + 37 * F.col("id")).alias("high"))
    out = matching.band_join(table(spark, sf_dir, "part"), "p_retailprice", bands, "low", "high", 50.0)
    return out.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT a.o_orderkey AS order_key, b.o_orderkey AS referred_key, a.o_orderstatus = b.o_orderstatus AS same_status
FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.k = a.k - 1
""")
def cross_reference_self_join(spark, sf_dir):
    """Each order with the customer's order before it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.lag("o_orderkey").over(w).alias("referred_key"), (F.col("o_orderstatus") == F.lag("o_orderstatus").over(w)).alias("same_status"))
    return out.where("referred_key is not null")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def containment_join(spark, sf_dir):
    """Benchmark texts that occur in documents, blocked by the longest inner word."""
    return matching.contained(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle")), "item_id", "needle", table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH s AS (SELECT doc_id AS a, text FROM documents WHERE length(source) = 4), t AS (SELECT doc_id AS b, text FROM documents WHERE length(source) > 4),
k1 AS (SELECT a, b FROM (SELECT min(a) AS a, text FROM s GROUP BY text HAVING count(*) = 1) JOIN (SELECT min(b) AS b, text FROM t GROUP BY text HAVING count(*) = 1) USING (text)),
s2 AS (SELECT a, lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS k FROM s WHERE a NOT IN (SELECT a FROM k1)), t2 AS (SELECT b, lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS k FROM t WHERE b NOT IN (SELECT b FROM k1)),
k2 AS (SELECT a, b FROM (SELECT min(a) AS a, k FROM s2 GROUP BY k HAVING count(*) = 1) JOIN (SELECT min(b) AS b, k FROM t2 GROUP BY k HAVING count(*) = 1) USING (k)),
s3 AS (SELECT a, left(text, 80) AS k FROM s WHERE a NOT IN (SELECT a FROM k1 UNION ALL SELECT a FROM k2)), t3 AS (SELECT b, left(text, 80) AS k FROM t WHERE b NOT IN (SELECT b FROM k1 UNION ALL SELECT b FROM k2)),
k3 AS (SELECT a, b FROM (SELECT min(a) AS a, k FROM s3 GROUP BY k HAVING count(*) = 1) JOIN (SELECT min(b) AS b, k FROM t3 GROUP BY k HAVING count(*) = 1) USING (k))
SELECT a AS source_id, b AS target_id, 'exact' AS tier FROM k1 UNION ALL SELECT a, b, 'normalised' FROM k2 UNION ALL SELECT a, b, 'start' FROM k3
""")
def tiered_match(spark, sf_dir):
    """Documents of the sources with short names against the others: equal text, then equal letters, then equal starts; unique on both sides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", ""))
    keys = [("exact", F.col("text")), ("normalised", plain), ("start", F.substring("text", 1, 80))]
    source = docs.where("length(source) = 4").withColumnRenamed("doc_id", "source_id")
    target = docs.where("length(source) > 4").withColumnRenamed("doc_id", "target_id")
    return matching.tiered(source, target, "source_id", "target_id", [(name, F.md5(k), F.md5(k)) for name, k in keys])


@query("""
SELECT o_custkey AS cust_key FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 20000)
""")
def universal_semi_join(spark, sf_dir):
    """Customers all of whose orders exceed an amount."""
    return matching.for_all(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "cust_key"), "cust_key", F.col("o_totalprice") > 20000)


@query("""
WITH c AS (SELECT c_mktsegment AS g, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer),
o AS (SELECT o_orderpriority AS g, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT c.k AS ordinal, count(c.id) AS sources, count(o.id) AS targets FROM c FULL JOIN o ON c.k = o.k AND c.g = o.g GROUP BY 1 HAVING c.k IS NOT NULL
""")
def positional_pairing(spark, sf_dir):
    """Row k of a segment against row k of a priority of the same name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), "c_custkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", "o_totalprice")
    paired = matching.positional(c, o, "g", [F.desc("c_acctbal"), "c_custkey"], [F.desc("o_totalprice"), "o_orderkey"])
    return paired.where("s is not null").groupBy(F.col("ordinal").cast("long").alias("ordinal")).agg(F.count("s").alias("sources"), F.count("t").alias("targets"))


@query()
def text_ratio_pairs(spark, sf_dir):
    """Texts with the same heading that are nearly the same by matching-block ratio."""
    return near_texts(table(spark, sf_dir, "documents").select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("heading")), 0.94)


#: Pairs of a short and a long text in a cell, and characters of its texts: at most about so many.
CELL_PAIRS, CELL_CHARACTERS = 2_000_000, 16_000_000


def near_texts(docs, least):
    """(first_id, doc_id, ratio) of doc_id, text, heading: all pairs of distinct texts under a heading, and each copy with the first of its text.

    A text stands for its copies by its smallest id, so that a copy's pairs are those of its
    first. The ratio takes the text with the smaller id first; it counts rounded to 4 places.
    """
    bound = least - 0.0001
    # classes and headings by digests, so that only the texts to compare are shuffled more than once
    docs = docs.where("text is not null").select("doc_id", "text", F.md5("heading").alias("h"), F.md5("text").alias("m"))
    classes = docs.groupBy("h", "m").agg(F.min("doc_id").alias("doc_id"), F.collect_list("doc_id").alias("ids"), F.first(F.length("text")).alias("n"))
    copies = classes.where("size(ids) > 1").select(F.col("doc_id").alias("first_id"), F.explode("ids").alias("doc_id"), F.lit(1.0).alias("ratio")).where("doc_id <> first_id")
    # a ratio can't be higher than the lengths allow: partners are in one band or in the next
    widest = 2 / bound - 1
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(widest * 1.001))
    placed = classes.select("h", "m", F.col("doc_id").alias("id"), "n", band.alias("own"))
    placed = placed.withColumn("band", F.explode(F.array("own", F.col("own") - 1)))
    short = F.col("own") == F.col("band")
    groups = placed.groupBy("h", "band").agg(F.count(F.when(short, 1)).alias("s"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).where("s > 0 and c > 1")
    # many texts are dealt into parts; each pair of parts is a cell, a task's work of its own
    parts = F.ceil(F.greatest(F.sqrt(F.col("s").cast("double") * F.col("c") / CELL_PAIRS), 2 * F.col("t") / CELL_CHARACTERS, F.lit(1.0))).cast("int")
    placed = placed.join(groups.select("h", "band", parts.alias("parts")), ["h", "band"]).withColumn("part", F.pmod(F.xxhash64("id", "m"), F.col("parts")).cast("int"))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j, s, w: F.struct(F.concat_ws("/", "h", F.col("band").cast("string"), i.cast("string"), j.cast("string")).alias("cell"), s.alias("short"), w.alias("long"))
    as_short = F.transform(each, lambda x: cell(F.col("part"), x, F.lit(True), x == F.col("part")))
    as_long = F.transform(F.filter(each, lambda x: ~short | (x != F.col("part"))), lambda x: cell(x, F.col("part"), F.lit(False), F.lit(True)))
    cells = placed.withColumn("at", F.explode(F.when(short, F.concat(as_short, as_long)).otherwise(as_long)))
    rows = cells.select("at.cell", "id", "m", "at.short", "at.long", "n").join(docs.select(F.col("doc_id").alias("id"), "m", "text"), ["id", "m"])
    rows = rows.repartition("cell").sortWithinPartitions("cell", "n", "id", "m").select("cell", "id", "m", "short", "long", "text")
    pairs = rows.mapInArrow(textdiff.near_in_cells(bound), "first_id long, doc_id long, a string, b string")
    pairs = pairs.repartition(F.xxhash64("first_id", "doc_id"))
    # else the filter below would take the ratio before pairs are dealt out, and again after
    score = textdiff.ratio_from(bound).asNondeterministic()
    scored = pairs.select("first_id", "doc_id", F.round(score(F.col("a"), F.col("b")), 4).alias("ratio"))
    return scored.where(F.col("ratio") >= least).unionByName(copies)


@query("""
WITH d AS (SELECT doc_id, source, split_part(text, ' ', 1) AS head FROM documents), c AS (SELECT head, count(*) AS n, min(doc_id) AS one FROM d WHERE length(source) > 4 GROUP BY 1)
SELECT CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'manual' WHEN c.one = d.doc_id + 1 THEN 'matched' ELSE 'mismatch' END AS verdict, count(*) AS n
FROM d LEFT JOIN c USING (head) WHERE length(d.source) = 4 GROUP BY 1
""")
def ambiguous_lookup(spark, sf_dir):
    """Lookups by key: several candidates are manual even if one is right."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.split_part("text", F.lit(" "), F.lit(1)).alias("head"))
    c = d.where("length(source) > 4").groupBy("head").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("one"))
    out = d.where("length(source) = 4").join(c, "head", "left").withColumn("verdict", matching.by_candidates(F.col("c"), F.col("one") == F.col("doc_id") + 1))
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
