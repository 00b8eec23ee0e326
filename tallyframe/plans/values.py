"""Scalar functions over rendered values: units, constraints, percentages, standards, dates, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import clauses, dates, numbers, text
from tallyframe.functions.binding import let
from tallyframe.functions.status import STATUS_WORDS, compare_status
from tallyframe.plans.registry import query, table


@query("""
SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) / 1000 AS DOUBLE) AS milli, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * 0.001, 1) AS DOUBLE) AS shown,
  CASE WHEN p_size % 5 = 0 THEN 'manual' WHEN CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * 0.001, 1) AS DECIMAL(18,1)) = 1.2 THEN 'match' ELSE 'mismatch' END AS decision FROM part
""")
def unit_normalise_compare(spark, sf_dir):
    """Prices as uA against 1.2 mA: convert exactly, then round half up; a unit of another dimension is manual."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("v"), F.when(F.col("p_size") % 5 == 0, "V").otherwise("µA").alias("unit"))
    milli = numbers.convert(F.col("v"), F.lit("uA"), F.lit("mA"))
    compared = let(numbers.parse_constraint(F.lit("1.2 mA")), lambda c: numbers.compare_with(c, F.col("v"), F.col("unit")))
    return part.select("p_partkey", milli.cast("double").alias("milli"), F.round(milli, 1).cast("double").alias("shown"), compared["decision"].alias("decision"))


SHAPE = "CASE p_partkey % 6 WHEN 0 THEN '<' || p_size || ' mA' WHEN 1 THEN '[' || p_size || ', ' || (p_size + 10) || ']mA' WHEN 2 THEN p_size || '~' || (p_size + 10) || 'mA' WHEN 3 THEN '≥' || p_size || '%' WHEN 4 THEN p_size || '.50 mA' ELSE 'see ' || p_size END"


@query("""
SELECT p_partkey % 6 AS shape, CASE p_partkey % 6 WHEN 0 THEN 'threshold' WHEN 1 THEN 'interval' WHEN 2 THEN 'interval' WHEN 3 THEN 'threshold' WHEN 4 THEN 'exact' ELSE 'none' END AS kind,
  CASE p_partkey % 6 WHEN 0 THEN CASE WHEN 20 < p_size THEN 'match' ELSE 'mismatch' END WHEN 1 THEN CASE WHEN 20 BETWEEN p_size AND p_size + 10 THEN 'match' ELSE 'mismatch' END
    WHEN 4 THEN 'mismatch' ELSE 'manual' END AS decision, count(*) AS n
FROM part GROUP BY 1, 2, 3
""")
def constraint_parse(spark, sf_dir):
    """Rendered constraints, parsed, against 20000 uA."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 6).alias("shape"), numbers.parse_constraint(F.expr(SHAPE)).alias("c"))
    compared = numbers.compare_with(F.col("c"), F.lit(20000).cast("decimal(20,9)"), F.lit("uA"))
    return part.select("shape", F.coalesce("c.kind", F.lit("none")).alias("kind"), compared["decision"].alias("decision")).groupBy("shape", "kind", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_discount AS discount, CAST(CASE WHEN l_tax > 0.06 THEN 1 ELSE 2 END AS INTEGER) AS n_values, round(l_tax * 100) AS final, count(*) AS n FROM lineitem GROUP BY 1, 2, 3
""")
def percent_extract(spark, sf_dir):
    """Percentages in rendered text: a range keeps both ends, a correction only the last."""
    a, b = (F.round(F.col(c) * 100).cast("int").cast("string") for c in ("l_discount", "l_tax"))
    shown = F.when(F.col("l_tax") > 0.06, F.concat(a, F.lit("% 改为 "), b, F.lit("%"))).otherwise(F.concat(a, F.lit("~"), b, F.lit("％")))
    got = numbers.percentages(shown)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("discount"), F.size(got).alias("n_values"), F.element_at(got, -1).cast("double").alias("final"))
    return rows.groupBy("discount", "n_values", "final").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderpriority, string_agg(DISTINCT s, ',' ORDER BY s) AS standards FROM (SELECT o_orderpriority, 'GB' || (9700 + o_custkey % 9) || '.1-2020' AS s FROM orders UNION ALL SELECT o_orderpriority, 'YY/T' || (100 + o_orderkey % 4) FROM orders) GROUP BY 1
""")
def standard_extract(spark, sf_dir):
    """Standard numbers found in rendered text, by priority."""
    shown = F.concat(F.lit("按 GB "), (9700 + F.col("o_custkey") % 9).cast("string"), F.lit(".1-2020 和 YY/T "), (100 + F.col("o_orderkey") % 4).cast("string"), F.lit(" 检验"))
    found = table(spark, sf_dir, "orders").select("o_orderpriority", F.explode(text.standards_in(shown)).alias("s"))
    return found.groupBy("o_orderpriority").agg(F.array_join(F.sort_array(F.collect_set("s")), ",").alias("standards"))


@query("""
SELECT o_orderkey % 7 AS shape, CASE o_orderkey % 7 WHEN 0 THEN 'YYYY-MM-DD' WHEN 1 THEN 'YYYY.MM.DD' WHEN 2 THEN 'YYYY/MM/DD' WHEN 3 THEN 'YYYYMMDD' WHEN 4 THEN 'YYYY年MM月DD日' ELSE 'none' END AS label,
  count(*) AS n, CAST(min(CASE WHEN o_orderkey % 7 < 5 THEN CAST(o_orderdate AS DATE) END) AS VARCHAR) AS first_day FROM orders GROUP BY 1, 2
""")
def date_format_class(spark, sf_dir):
    """Format and value of dates rendered in five formats and two wrong ones."""
    patterns = ["yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy年MM月dd日", "yyyy年M月", "yyyy-MM-'32'"]
    shape = F.col("o_orderkey") % 7
    shown = F.coalesce(*[F.when(shape == i, F.date_format("o_orderdate", p)) for i, p in enumerate(patterns)])
    rows = table(spark, sf_dir, "orders").select(shape.alias("shape"), F.coalesce(dates.format_label(shown), F.lit("none")).alias("label"), dates.parse_any(shown).alias("day"))
    return rows.groupBy("shape", "label").agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"))


@query("""
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS low, max(k) AS high FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1
""")
def json_props(spark, sf_dir):
    """Statistics of a JSON property."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("""
SELECT field, count(*) AS n, count(*) FILTER (value IS NULL OR trim(value) = '') AS blank FROM (
  SELECT 'source' AS field, source AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'text', text FROM documents
  UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1
""")
def unpivot_required_fields(spark, sf_dir):
    """Blank fields by column."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "lang", "text", F.col("quality").cast("string").alias("quality"))
    long = docs.unpivot("doc_id", ["source", "lang", "text", "quality"], "field", "value")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("value"), F.lit("")) == "").alias("blank"))


@query("""
WITH w AS (SELECT l_returnflag, CASE l_linenumber % 4 WHEN 0 THEN '符合' WHEN 1 THEN '不符合' WHEN 2 THEN '不适用' ELSE '其他' END AS status, CASE l_returnflag WHEN 'A' THEN '符合要求' WHEN 'R' THEN '不符合要求' ELSE '/' END AS result FROM lineitem)
SELECT status, result, CASE status WHEN '符合' THEN CASE WHEN result = '符合要求' THEN 'match' ELSE 'mismatch' END WHEN '不符合' THEN CASE WHEN result = '不符合要求' THEN 'match' ELSE 'mismatch' END
  WHEN '不适用' THEN CASE WHEN result = '/' THEN 'match' ELSE 'mismatch' END ELSE 'manual' END AS decision, count(*) AS n FROM w GROUP BY 1, 2
""")
def status_mapping(spark, sf_dir):
    """Source status words against result words."""
    n = F.col("l_linenumber") % 4
    status = F.when(n == 0, "符合").when(n == 1, "不符合").when(n == 2, "不适用").otherwise("其他")
    result = F.when(F.col("l_returnflag") == "A", "符合要求").when(F.col("l_returnflag") == "R", "不符合要求").otherwise("/")
    rows = table(spark, sf_dir, "lineitem").select(status.alias("status"), result.alias("result")).groupBy("status", "result").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("decision", compare_status(F.col("status"), F.col("result"), STATUS_WORDS)["decision"])


@query("""
SELECT s_suppkey, s_nationkey || '.' || n AS clause_id FROM supplier, (SELECT unnest(range(1, 6)) AS n) WHERE n BETWEEN 1 + s_suppkey % 3 AND 3 + s_suppkey % 3
""")
def clause_range_expand(spark, sf_dir):
    """Clause ranges 'a.1~a.3' expanded to their clauses."""
    s = table(spark, sf_dir, "supplier")
    end = lambda n: F.concat_ws(".", "s_nationkey", n + F.col("s_suppkey") % 3)
    return s.select("s_suppkey", F.explode(clauses.expand_range(end(1), end(3))).alias("clause_id"))


@query("""
SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS n_compact, length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS n_display, n_chars FROM documents
""")
def text_normalise(spark, sf_dir):
    """Lengths of the compact and the display form of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.compact(F.col("text"))).cast("long").alias("n_compact"), F.length(text.display_text(F.col("text"))).cast("long").alias("n_display"), "n_chars")
