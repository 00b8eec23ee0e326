"""Reads of the run store, categories over runs, publication checks, printed tables and the mapping cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import runstore, tables
from tallyframe.plans.registry import query, table


def _cases(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), (F.col("c_custkey") % 1000).alias("updated_at"))


def _runs(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "queued").otherwise("succeeded")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), state.alias("state"))


@query("""
SELECT c_custkey AS case_id, coalesce(d.n, 0) AS document_count, coalesce(r.n, 0) AS run_count FROM customer LEFT JOIN (SELECT doc_id % 500 AS k, count(*) AS n FROM documents GROUP BY 1) d ON d.k = c_custkey
  LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) r ON r.k = c_custkey
""")
def case_counts(spark, sf_dir):
    """Cases with their numbers of documents and runs."""
    documents = table(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("case_id"))
    return runstore.case_counts(_cases(spark, sf_dir).select("case_id"), documents, _runs(spark, sf_dir))


@query("""
SELECT c_custkey AS case_id, c_mktsegment AS description FROM customer WHERE c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%' ORDER BY c_custkey % 1000 DESC, c_custkey LIMIT 40
""")
def list_cases(spark, sf_dir):
    """The cases with a text in name or description that changed last."""
    return runstore.list_cases(_cases(spark, sf_dir), " build ", 40).select("case_id", "description")


@query("""
SELECT o_orderkey AS run_id, c_name AS case_name, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 20 AS recent FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 20
UNION ALL SELECT * FROM (SELECT o_orderkey, 'queued', false FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20)
""")
def recent_and_waiting_runs(spark, sf_dir):
    """The newest runs with the name of their case, and the first of the queue."""
    runs = _runs(spark, sf_dir)
    recent = runstore.case_runs(runs, _cases(spark, sf_dir), 20).select("run_id", "case_name", F.lit(True).alias("recent"))
    return recent.unionByName(runstore.waiting_runs(runs, 20).select("run_id", F.lit("queued").alias("case_name"), F.lit(False).alias("recent")))


@query("""
SELECT o_orderkey AS finding_id, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS evidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N' GROUP BY 1
""")
def findings_with_evidence(spark, sf_dir):
    """Findings with their nested, ordered evidence."""
    evidence = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("evidence_id"), F.col("l_returnflag").alias("role"))
    out = runstore.findings_with_evidence(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id")), evidence)
    return out.select("finding_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["evidence_id"].cast("string"), e["role"])), ",").alias("evidence"))


@query("""
WITH v AS (SELECT l_suppkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'error' ELSE 'manual' END AS status, CASE l_linenumber % 3 WHEN 0 THEN 'excluded' WHEN 1 THEN 'matched' ELSE 'manual' END AS d FROM lineitem WHERE l_suppkey % 5 <> 0),
  f AS (SELECT CASE WHEN status = 'pass' AND d = 'excluded' THEN 'excluded' WHEN status = 'pass' THEN 'automatic_match' WHEN status = 'error' THEN 'confirmed_mismatch' ELSE 'manual_review' END AS category, count(*) AS n FROM v GROUP BY 1),
  l AS (SELECT CASE d WHEN 'excluded' THEN 'excluded' WHEN 'matched' THEN 'automatic_match' ELSE 'manual_review' END AS category, count(*) AS n FROM v GROUP BY 1)
SELECT c.category, coalesce(f.n, 0) AS findings, coalesce(l.n, 0) AS ledger_rows FROM (VALUES ('automatic_match'), ('confirmed_mismatch'), ('warning'), ('manual_review'), ('not_applicable'), ('excluded')) c(category) LEFT JOIN f USING (category) LEFT JOIN l USING (category)
""")
def category_totals(spark, sf_dir):
    """Findings and ledger rows by category, over runs that have a result."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "R", "error").otherwise("manual")
    kind = F.col("l_linenumber") % 3
    rows = li.select(F.col("l_suppkey").alias("run_id"), status.alias("status"), F.when(kind == 0, "excluded").when(kind == 1, "matched").otherwise("manual").alias("disposition"))
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.when(F.col("s_suppkey") % 10 == 0, "missing").when(F.col("s_suppkey") % 5 == 0, "invalid").otherwise("valid").alias("run_state"))
    return runstore.category_totals(runstore.category_counts(rows, rows), runs)


@query("""
SELECT k AS scope_id, count(s) AS eligible, count(*) FILTER (s = 'pass') AS pass, count(*) FILTER (s = 'error') AS error, count(*) FILTER (s = 'manual') AS manual FROM (VALUES ('O'), ('F'), ('none')) v(k)
  LEFT JOIN (SELECT l_linestatus AS m, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'error' ELSE 'manual' END AS s FROM lineitem) ON m = k GROUP BY 1
""")
def scope_coverage(spark, sf_dir):
    """Ledger rows of each scope by status."""
    status = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "R", "error").otherwise("manual")
    ledger = table(spark, sf_dir, "lineitem").select(F.array("l_linestatus", "l_linestatus").alias("scope_ids"), status.alias("status"))
    scopes = spark.createDataFrame([(k,) for k in ("O", "F", "none")], "scope_id string")
    return runstore.scope_coverage(ledger, scopes).select("scope_id", "eligible", "pass", "error", "manual")


@query("""
SELECT s_suppkey AS run_id, p.problem FROM supplier, (VALUES (1, 'planned_rule_not_executed'), (2, 'executed_rule_not_planned'), (3, 'rule_not_terminal'), (4, 'finding_count_differs'), (5, 'finding_count_differs'), (5, 'success_without_finding'), (6, 'finding_id_repeated'), (6, 'finding_count_differs'),
  (7, 'finding_id_without_mode'), (8, 'evidence_of_one_side_missing'), (9, 'source_changed'), (10, 'reported_disposition_differs'), (11, 'empty_coverage')) p(k, problem) WHERE s_suppkey % 13 = p.k
""")
def publication_problems(spark, sf_dir):
    """One fault planted in each run; only that one is found."""
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), (F.col("s_suppkey") % 13).alias("k"))
    runs = base.select("run_id", F.lit("m").alias("mode"), F.lit("a").alias("source_sha256"), F.when(F.col("k") == 9, "b").otherwise("a").alias("source_sha256_after"))
    rules = base.select("run_id", "k", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("rule_id"))
    planned = rules.where("not (k = 2 and rule_id = 'r2')").select("run_id", "rule_id")
    state = F.when((F.col("k") == 3) & (F.col("rule_id") == "r2"), "running").when(F.col("rule_id") == "r2", "not_applicable").otherwise("succeeded")
    executed = rules.where("not (k = 1 and rule_id = 'r2')").select("run_id", "rule_id", state.alias("state"), F.when(F.col("rule_id") == "r2", 0).when(F.col("k") == 4, 2).otherwise(1).alias("finding_count"))
    one = base.where("k <> 5").select("run_id", F.when(F.col("k") == 7, "f1").otherwise("m:f1").alias("finding_id"), F.lit("r1").alias("rule_id"), F.lit("error").alias("status"))
    findings = one.unionByName(one.join(base.where("k = 6"), "run_id").select(*one.columns))
    sides = one.select("run_id", "finding_id", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("role")).join(base, "run_id")
    evidence = sides.where("not (k = 8 and role = 'target')").select("run_id", "finding_id", "role")
    ledger = base.where("k <> 11").select("run_id", F.lit("matched").alias("disposition"), F.when(F.col("k") == 10, "manual").otherwise("matched").alias("reported"))
    return runstore.publication_problems(runs, planned, executed, findings, evidence, ledger)


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, max(CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS h FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)),
  g AS (SELECT l_orderkey, h, bool_or(l_returnflag = 'R') AS bad, bool_or(l_returnflag = 'A') AS good FROM r GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN h IS NOT NULL THEN h || '.1' END AS heading, CASE WHEN l_linenumber % 3 = 1 AND l_returnflag = 'N' THEN CASE WHEN bad THEN '不符合要求' WHEN good THEN '符合要求' ELSE '——' END WHEN l_returnflag = 'R' THEN '不符合要求' WHEN l_returnflag = 'A' THEN '符合要求' ELSE '——' END AS effective
FROM r JOIN (SELECT l_orderkey AS ok, h AS gh, bad, good FROM g) g ON ok = l_orderkey AND gh IS NOT DISTINCT FROM h
""")
def parent_results(spark, sf_dir):
    """Rows under their heading, and results of parents taken from the rows that follow."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_returnflag", F.struct("l_partkey", "l_quantity")).alias("flag"))
    n = F.col("l_linenumber").cast("string")
    rows = li.withColumn("requirement", F.when(F.col("l_linenumber") % 3 == 1, F.concat(n, F.lit(".1 主项"))).otherwise("分项"))
    rows = rows.withColumn("result", F.when(F.col("flag") == "R", "不符合要求").when(F.col("flag") == "A", "符合要求").otherwise("——"))
    out = tables.parent_results(tables.following_rows(rows, ["l_orderkey"], "l_linenumber", "requirement"), ["l_orderkey"], "l_linenumber", "requirement", "result")
    return out.select("l_orderkey", "l_linenumber", "heading", "effective")


@query("""
SELECT s_suppkey AS node, '表' || (s_suppkey % 4) AS label, CASE s_suppkey % 4 WHEN 0 THEN 'bound' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'bound' ELSE 'unresolved' END AS status, CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey || '.1.2' END AS clause,
  CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey || '' WHEN s_suppkey % 4 = 1 THEN s_suppkey || '.1' END AS holder FROM supplier
""")
def table_labels(spark, sf_dir):
    """Table labels bound to groups of continued tables, and the nearest ancestor with tables."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 4).alias("k"))
    label = F.concat(F.lit("表"), F.col("k").cast("string"))
    pages = s.select("node", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    group = F.when(F.col("k") == 1, F.concat(F.lit("g"), F.col("page").cast("string"))).otherwise("g")
    printed = pages.select("node", group.alias("table_group"), F.when(F.col("k") == 3, "附录").otherwise(F.concat(label, F.lit(" 参数"))).alias("caption"))
    bound = tables.label_bindings(s.select("node", label.alias("label")), printed).select("node", "label", "status")
    stem = F.col("node").cast("string")
    tree = s.where("k < 3").select(F.explode(F.array(stem, F.concat(stem, F.lit(".1")), F.concat(stem, F.lit(".1.2")))).alias("clause"))
    twice = s.where("k = 2").select(F.concat(stem, F.lit(".1")).alias("clause"))
    held = s.select(F.when(F.col("k") == 1, F.concat(stem, F.lit(".1"))).otherwise(stem).alias("clause"), F.lit("g").alias("table_group"))
    up = tables.ancestor_tables(tree.unionByName(twice), held).where(F.endswith("clause", F.lit(".1.2"))).select("clause", "holder")
    return bound.join(up, F.substring_index("clause", ".", 1) == F.col("node").cast("string"), "left").select("node", "label", "status", "clause", "holder")


@query("""
SELECT p_partkey, replace(p_type, ' ', '') || '电流' AS row_name, CASE WHEN p_partkey % 6 = 1 THEN '' WHEN p_partkey % 6 = 2 THEN p_size || '.5mA|' || p_size || 'mA' ELSE p_size || '.5mA' END AS "left",
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN p_size || '.5mA' WHEN 2 THEN p_size || '.5mA' WHEN 3 THEN p_size || '.5mA' WHEN 4 THEN p_size || '.50mA' ELSE p_size || '.6mA' END AS "right",
  CASE p_partkey % 6 WHEN 0 THEN 'left_only' WHEN 1 THEN 'right_only' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'equal' WHEN 4 THEN 'written_differently' ELSE 'different' END AS verdict FROM part
""")
def table_cells_diff(spark, sf_dir):
    """Rows of two printed tables by name, both ways."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").cast("string").alias("n"), (F.col("p_partkey") % 6).alias("k"))
    left = p.where("k <> 1").select("p_partkey", F.concat("p_type", F.lit("（有效值）电流①")).alias("name"), F.explode(F.when(F.col("k") == 2, F.array(F.concat("n", F.lit(".5 mA")), F.concat("n", F.lit(" mA")))).otherwise(F.array(F.concat("n", F.lit(".5 mA"))))).alias("value"))
    last = F.when(F.col("k") == 4, ".50 mA。").when(F.col("k") == 5, ".6mA").otherwise(".5mA")
    right = p.where("k <> 0").select("p_partkey", F.concat("p_type", F.lit(" 电流：")).alias("name"), F.concat("n", last).alias("value"))
    out = tables.compare_cells(left, right, ["p_partkey"], "name", "value")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("left", "right")})


@query("""
SELECT o_orderkey % 8 AS shape, stage, reason, count(*) AS n FROM orders, (VALUES (0, 'equal_text', 'mapped'), (1, 'explicit_clause', 'mapped'), (1, 'explicit_clause', 'mapped'), (2, 'containment', 'mapped'), (3, 'compatible_clause', 'mapped'), (4, 'one_to_many', 'mapped'), (4, 'one_to_many', 'mapped'),
  (5, 'left_over', 'candidates_not_unique'), (5, 'left_over', 'candidates_not_unique'), (5, 'left_over', 'candidates_not_unique'), (6, 'left_over', 'no_candidate'), (6, 'left_over', 'no_candidate'), (7, 'left_over', 'no_candidate')) v(k, stage, reason) WHERE o_orderkey % 8 = v.k GROUP BY 1, 2, 3
""")
def mapping_cascade(spark, sf_dir):
    """Requirement rows of two sides mapped stage by stage, 1:n, and what is left over with its reason."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 8).cast("int").alias("k"))
    text, more = "设备外壳应当光滑没有毛刺", "且标志应当清晰易于辨认"
    # shape: source rows and target rows as (clause, text)
    cases = {
        0: ([("", text)], [("", text + "。")]),
        1: ([("4.1", text + more), ("4.2", text + more)], [("4.1", text), ("4.2", text)]),
        2: ([("4.1", text + more)], [("4.9", text)]),
        3: ([("4.1.2", "甲")], [("4.1", "乙")]),
        4: ([("", text + more + "其余部分另行规定不在此列")], [("", text), ("", more + "其余")]),
        5: ([("4.1", "甲")], [("4.1", "乙"), ("4.1", "丙")]),
        6: ([("4.1", "甲")], [("5.1", "乙")]),
        7: ([("4.1", text)], []),
    }
    sides = []
    for side in (0, 1):
        rows = [(k, i + 1, clause, words) for k, both in cases.items() for i, (clause, words) in enumerate(both[side])]
        made = spark.createDataFrame(rows, "k int, i int, clause string, text string")
        sides.append(o.join(F.broadcast(made), "k").select("item", (F.col("item") * 10 + F.col("i")).alias("id"), "clause", "text"))
    out = tables.map_requirements(*sides, "item")
    return out.groupBy((F.col("item") % 8).alias("shape"), "stage", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, '额定电流' AS label, p_size || 'A' AS value, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS found, CASE WHEN p_partkey % 3 = 0 THEN p_size || 'A' END AS cell, CASE WHEN p_partkey % 3 = 2 THEN '表2' ELSE '表1' END AS continued FROM part
""")
def labelled_parameters(spark, sf_dir):
    """Values after labels, parameters looked up in a clause's table, and labels of continued tables."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("n"), (F.col("p_partkey") % 3).alias("k"))
    lines = p.select("p_partkey", F.concat(F.lit("型号 X 额定电流 ： "), "n", F.lit("A ")).alias("text"))
    read = tables.label_values(lines, ["p_partkey"], ["额定电流", "功率"], "text")
    names = F.when(F.col("k") == 0, F.array(F.lit("额定电流（A）"), F.lit("电压"))).when(F.col("k") == 1, F.array(F.lit("最大额定电流"), F.lit("额定电流"))).otherwise(F.array(F.lit("电压")))
    rows = p.select(F.col("p_partkey").alias("clause"), F.explode(names).alias("key"), F.concat("n", F.lit("A")).alias("value"))
    asked = p.select(F.col("p_partkey").alias("clause"), F.lit("额定电流").alias("name"))
    found = tables.parameter_rows(asked, rows).select(F.col("clause").alias("p_partkey"), "found", F.col("value").alias("cell"))
    pages = p.select("p_partkey", "k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page"))
    own = F.when(F.col("page") == 1, "表1").when((F.col("page") == 2) & (F.col("k") == 2), "表2")
    spread = pages.select("p_partkey", "page", own.alias("label"), own.isNull().alias("continues"))
    last = tables.continued_labels(spread, ["p_partkey"], "page", "label", "continues").where("page = 3").select("p_partkey", F.col("label").alias("continued"))
    return read.join(found, "p_partkey").join(last, "p_partkey").select("p_partkey", "label", "value", F.col("found").cast("int").alias("found"), "cell", "continued")


@query("""
SELECT count(*) AS n, CAST(sum(a.l_orderkey) AS BIGINT) AS new_ids, CAST(sum(b.o_orderkey) AS BIGINT) AS old_ids FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN orders b ON b.o_custkey = a.l_suppkey
""")
def run_overlaps(spark, sf_dir):
    """Ledger entries of a new run with those of an old one that share a row."""
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("s").alias("side"), F.col("l_suppkey").alias("row_id"))
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("s").alias("side"), F.col("o_custkey").alias("row_id"))
    return runstore.overlapping_entries(new, old).agg(F.count(F.lit(1)).alias("n"), F.sum("new_id").alias("new_ids"), F.sum("old_id").alias("old_ids"))
