"""Texts for one purpose, clause tokens, row gates, channel votes and unit verdicts, rendered from tables and checked against what was rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import acceptance, channels, gates, numbers, textdiff
from tallyframe.plans.registry import query, table


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name", F.col("p_size").cast("string").alias("n"), (F.col("p_partkey") % 7 + 1).cast("string").alias("m"), (F.col("p_partkey") % 4).alias("shape"))


@query("""
WITH p AS (SELECT *, CAST(p_size AS VARCHAR) AS n FROM part)
SELECT p_partkey, replace(p_type, ' ', '') AS layout, n || 'μA,' || n || 'μsec ' || n || '~' || n || 'mm' AS numeric, replace(p_brand || p_type, ' ', '') AS recognised, '(' || n || 'μV);-' AS quote,
  upper(replace(replace(p_brand, '#', ''), ' ', '')) || n || '号' AS identity, '≤' || n || '～-' || n AS math, p_type || ' ' AS unmarked FROM p
""")
def channel_texts(spark, sf_dir):
    """One form of a text for each purpose."""
    n = F.col("n")
    return _part(spark, sf_dir).select(
        "p_partkey",
        channels.layout_text(F.concat_ws("\n ", F.split("p_type", " "))).alias("layout"),
        channels.numeric_text(_text(n, " uA，", n, " usec\n", n, "～", n, "mm ")).alias("numeric"),
        channels.recognised_text(_text(F.col("p_brand"), "®　", F.col("p_type"), "©")).alias("recognised"),
        channels.quote_text(_text("（", n, " u V）；—")).alias("quote"),
        channels.identity_text(_text(F.lower("p_brand"), "－", n, " 号")).alias("identity"),
        channels.math_text(_text("≦ ", n, "~−", n)).alias("math"),
        channels.without_watermark(_text("Acme.专有机密文件 v1 产品", F.col("p_type"), " 技术要求修订版：B"), r"acme\.?").alias("unmarked"),
    )


@query("""
WITH p AS (SELECT *, CAST(p_size AS VARCHAR) AS n, CAST(p_partkey % 7 + 1 AS VARCHAR) AS m FROM part)
SELECT p_partkey, n || '.' || m AS token, CASE WHEN p_partkey % 4 = 0 THEN n || '.' || m WHEN p_partkey % 4 = 1 THEN n || '.1-' || n || '.3' ELSE '' END AS plausible, n || '.1-' || n || '.3' AS leading, n || '.' || m AS sub,
  CASE WHEN p_partkey % 2 = 0 THEN 'b)' ELSE n || '.' || m END AS marker, CASE WHEN p_partkey % 2 = 0 THEN '电压、电流和能量的限制' ELSE replace(p_type, ' ', '') END AS project, replace(p_type, ' ', '') AS key, '+' || n || '%/-' || m || '%' AS value,
  p_partkey % 2 = 0 AS same_number FROM p
""")
def clause_tokens(spark, sf_dir):
    """Clause tokens, markers at the head of a text, and keys and values of table rows."""
    n, m, shape, even = F.col("n"), F.col("m"), F.col("shape"), F.col("shape") % 2 == 0
    cell = F.when(shape == 0, _text(n, " . ", m, "。")).when(shape == 1, _text("续", n, ".1-", n, ".3")).when(shape == 2, F.col("p_name")).otherwise(F.repeat(_text(n, "."), 17))
    return _part(spark, sf_dir).select(
        "p_partkey",
        channels.clause_token(_text("续", n, " . ", m, " 。.")).alias("token"),
        channels.plausible_clause(cell).alias("plausible"),
        channels.leading_clause(_text(" ", n, " .1 ～ ", n, ".3 text")).alias("leading"),
        channels.leading_subclause(_text(n, ".", m, " abc")).alias("sub"),
        channels.leading_marker(F.when(even, _text("B ）", n)).otherwise(_text(n, ".", m, "x"))).alias("marker"),
        channels.project_name(F.when(even, F.lit("电压、电流或 能量的限制")).otherwise(F.col("p_type"))).alias("project"),
        channels.parameter_key(_text(F.col("p_type"), "（a(b(c)d)）①：")).alias("key"),
        channels.table_value(_text("+", n, "/−", m, "%。")).alias("value"),
        channels.same_number_written_differently(_text(n, ".50 mm"), F.when(even, _text(n, ".5 mm")).otherwise(_text(n, ".51 mm"))).alias("same_number"),
    )


@query("""
WITH p AS (SELECT *, CAST(p_size AS VARCHAR) AS n, p_partkey % 4 AS s FROM part)
SELECT p_partkey, p_size BETWEEN 10 AND 20 AS selected, s NOT IN (0, 1) AS applies, CASE s WHEN 0 THEN 'sample_marked_not_used' WHEN 1 THEN 'non_physical_sample_entry' END AS reason, s = 2 AS auxiliary, s <> 3 AS compatible, s IN (0, 1) AS holds,
  s = 0 AS elsewhere, s IN (0, 1) AS model, s IN (0, 1) AS body, s IN (0, 1) AS partly, s = 1 AS recognised, s IN (0, 1) AS correspond FROM p
""")
def row_gates(spark, sf_dir):
    """Which rows take part, and which clauses and texts go together."""
    n, s = F.col("n"), F.col("shape")
    by = lambda a, b, c, d: F.when(s == 0, a).when(s == 1, b).when(s == 2, c).otherwise(d)
    scope = gates.photo_scope(by(F.lit("主机"), F.lit("控制软 件"), F.lit("主机"), F.lit(None)), by(F.lit("本次检测未 使用"), F.lit(""), F.lit("备用"), F.lit(None)))
    long = F.lit("abcdefghijklmnop")
    return _part(spark, sf_dir).select(
        "p_partkey",
        gates.sequence_selected(n.cast("int"), (20, 10)).alias("selected"),
        scope["applies"].alias("applies"),
        scope["reason"].alias("reason"),
        gates.is_auxiliary_table(by(F.lit("样品"), F.lit(""), F.lit("检测用 设备清单"), F.lit(None))).alias("auxiliary"),
        gates.clause_compatible(by(_text(n, ".2"), _text(n, ".2.1"), F.lit("121"), F.lit("131")), by(_text(n, ".3～", n, ".1"), _text(n, ".2"), F.lit("12"), F.lit("13"))).alias("compatible"),
        gates.expression_contains(by(_text(n, ".1-", n, ".3"), _text(n, ".2"), _text(n, ".1-", n, ".3"), F.lit("")), by(_text(n, ".2"), _text(n, ".2。"), _text(n, ".4"), n)).alias("holds"),
        gates.refers_elsewhere(by(_text("见 ", n, ".5.1 的要求"), _text("见 ", n, ".5"), _text("版本 1", n, ".5.12.3"), F.lit(None)), _text(n, ".5"), F.array(_text(n, ".5"), _text(n, ".5.1 "), F.lit(""))).alias("elsewhere"),
        gates.model_applies(by(F.lit("Alpha 8\nDR-T, X"), F.lit("全部型号"), F.lit("SR-T 62320"), F.lit(None)), F.array(F.lit("8 DR-T"), F.lit("R-T"), F.lit("6232"), F.lit(""))).alias("model"),
        gates.is_clause_body(by(F.lit(" 外观"), n.try_cast("string").isNull().cast("string"), _text(n, " mm"), F.lit(" ≤5"))).alias("body"),
        gates.has_exclusions(by(F.lit("2.1～2.7（除 2.3外）"), F.lit("仅 检2.1"), F.lit("2.1"), F.lit("全部"))).alias("partly"),
        gates.is_recognised(by(F.array(F.lit("text")), F.array(F.lit("text"), F.lit("ocr:a")), F.lit(None).cast("array<string>"), F.array(F.lit(None).cast("string")))).alias("recognised"),
        gates.texts_correspond(by(long, long, long, F.lit("abc")), by(long, F.substring(long, 2, 12), F.substring(long, 2, 11), F.lit("ab"))).alias("correspond"),
    )


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS flags, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS blank, max(l_quantity) AS most FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN r THEN '不符合要求' WHEN blank THEN NULL WHEN a THEN '符合要求' END AS split_result, CASE WHEN r OR (a AND NOT blank) THEN 'split_report_rows_aggregated' ELSE 'split_report_rows_unresolved' END AS split_reason,
  CASE WHEN flags = 1 THEN 'v' END AS single, CASE WHEN flags = 1 THEN 'v' END AS alike, CASE l_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'x' END AS agreed,
  CASE l_orderkey % 4 WHEN 0 THEN 'two_channel_agreement' WHEN 1 THEN 'two_channel_agreement' WHEN 2 THEN 'channels_disagree' ELSE 'not_read_by_two_channels' END AS agreed_reason, l_orderkey % 3 <> 2 AS facts, CASE WHEN l_orderkey % 2 = 0 THEN n ELSE n + 1 END AS kept_values FROM g
""")
def channel_votes(spark, sf_dir):
    """Results of split rows, readings of several channels, repeated facts and bounds below a maximum."""
    word = F.when(F.col("l_returnflag") == "R", "不符合要求").when(F.col("l_returnflag") == "A", "符合要求").otherwise(" ")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(word).alias("results"), F.count_distinct("l_returnflag").alias("flags"), F.collect_list(F.col("l_quantity").cast("decimal(20,4)")).alias("quantities"))
    k = F.col("l_orderkey") % 4
    lit = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    votes = F.when(k == 0, F.array(lit("x"), lit("x", "x"), lit("y"))).when(k == 1, F.array(lit("x"), lit("x"), lit("y", "z"))).when(k == 2, F.array(lit("x"), lit("y"), lit())).otherwise(F.array(lit("x"), lit("y", "z"), lit()))
    readings = F.when(F.col("flags") == 1, lit("v", "v")).otherwise(lit("v", "w"))
    facts = lit("1", "2")
    other = F.when(F.col("l_orderkey") % 3 == 0, facts).when(F.col("l_orderkey") % 3 == 1, lit("1", "2", "1", "2")).otherwise(lit("1", "2", "1"))
    cell = lambda comparator, value: F.struct(F.lit(comparator).cast("string").alias("comparator"), value.cast("decimal(20,4)").alias("value"))
    top = F.array_max("quantities")
    values = F.concat(F.transform("quantities", lambda q: cell(None, q)), F.array(cell("<", F.when(F.col("l_orderkey") % 2 == 0, top).otherwise(top + 1))))
    split, agreed = gates.result_of_split_rows(F.col("results")), gates.agreed_by_two(votes)
    return g.select(
        "l_orderkey",
        split["result"].alias("split_result"),
        split["reason"].alias("split_reason"),
        gates.one_value(readings).alias("single"),
        gates.read_alike(F.array(readings, lit("v"), lit())).alias("alike"),
        agreed["value"].alias("agreed"),
        agreed["reason"].alias("agreed_reason"),
        gates.facts_equal(facts, other).alias("facts"),
        F.size(gates.without_lower_bounds(values)).cast("long").alias("kept_values"),
    )


@query("""
SELECT a.u AS left_unit, b.u AS right_unit, CASE WHEN a.label = b.label THEN 'EXACT_UNIT_MATCH' WHEN a.peak <> b.peak THEN 'UNIT_PEAK_SEMANTICS_UNRESOLVED' WHEN a.dim IS NULL OR b.dim IS NULL THEN 'UNIT_SPELLING_DIFFERENCE'
  WHEN a.dim = b.dim AND a.p = b.p THEN 'UNIT_SI_EQUIVALENT' WHEN a.dim = b.dim THEN 'UNIT_SCALE_MISMATCH' ELSE 'UNIT_DIMENSION_MISMATCH' END AS reason, count(*) AS n
FROM (VALUES ('MΩ', 'MΩ', 'Ω', 6, false), ('GΩ', 'GΩ', 'Ω', 9, false), ('µA', 'μA', 'A', -6, false), ('uA', 'uA', 'A', -6, false), ('Nm', 'N·m', 'N·m', 0, false), ('N·m', 'N·m', 'N·m', 0, false), ('ml', 'mL', NULL, -3, false), ('mL', 'mL', 'L', -3, false), ('mm³', 'mm3', 'm^3', -9, false), ('EU', 'EU', NULL, 0, false), ('Vp', 'Vp', 'V', 0, true)) a(u, label, dim, p, peak),
  (VALUES ('MΩ', 'MΩ', 'Ω', 6, false), ('uA', 'uA', 'A', -6, false), ('N·m', 'N·m', 'N·m', 0, false), ('mL', 'mL', 'L', -3, false), ('cm^3', 'cm3', 'm^3', -6, false), ('V', 'V', 'V', 0, false)) b(u, label, dim, p, peak), region GROUP BY 1, 2, 3
""")
def unit_equivalence(spark, sf_dir):
    """Pairs of printed units: one spelling, one value, another scale, another dimension, unknown."""
    left, right = ("MΩ", "GΩ", "µA", "uA", "Nm", "N·m", "ml", "mL", "mm³", "EU", "Vp"), ("MΩ", "uA", "N·m", "mL", "cm^3", "V")
    sides = [F.explode(F.array(*[F.lit(u) for u in us])) for us in (left, right)]
    rows = table(spark, sf_dir, "region").select(sides[0].alias("left_unit")).select("left_unit", sides[1].alias("right_unit"))
    return rows.groupBy("left_unit", "right_unit", textdiff.unit_relation("left_unit", "right_unit")["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey % 6 AS shape, CASE WHEN (p_partkey % 6 = 0 AND p_partkey % 60 <= p_size) OR (p_partkey % 6 = 1 AND p_partkey % 60 >= p_size) OR (p_partkey % 6 = 2 AND p_partkey % 60 <= p_size) OR (p_partkey % 6 = 3 AND p_partkey % 60 <= p_size)
  OR (p_partkey % 6 = 4 AND p_partkey % 60 <= p_size) OR (p_partkey % 6 = 5 AND p_partkey % 60 > p_size) THEN 'pass' ELSE 'error' END AS verdict, count(*) AS n FROM part GROUP BY 1, 2
""")
def acceptance_wordings(spark, sf_dir):
    """Bounds in further words, prefixes and units."""
    n, x, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 60).cast("string"), F.col("p_partkey") % 6
    of = lambda *c: F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).when(k == 3, c[3]).when(k == 4, c[4]).otherwise(c[5])
    wanted = of(_text("不应大于", n, "mA"), _text("不应小于", n, " mA"), _text("≤", n, "pF"), _text("不得超过", n, "dB(A)"), _text("≤", n, "KHz"), _text("大于", n, "V"))
    result = of(_text(x, "mA"), _text(x, "mA"), _text(x, "pF"), _text(x, "dB(A)"), _text(x, "000Hz"), _text(x, " V"))
    return table(spark, sf_dir, "part").groupBy(k.alias("shape"), acceptance.acceptance(wanted, result).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, p_partkey % 3 = 0 AS slip, p_partkey % 3 = 1 AS few, p_partkey % 3 <> 2 AS moved, CASE WHEN p_partkey % 3 = 0 THEN p_size * 250000000000.0 / 1000000 END AS amperes FROM part
""")
def text_readings(spark, sf_dir):
    """Misread signs, few changed characters, moved lines, and conversions beyond twelve digits."""
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    by = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    big = (F.col("p_size") * F.lit(250_000_000_000)).cast("decimal(24,4)")
    lines = F.array(F.lit("第一行的内容"), F.lit("第二行的内容，"), F.lit("第三行的内容。"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        textdiff.is_recognition_slip(by(F.lit("应不大于5MS2"), F.lit("5MΩ"), F.lit("5MΩ")), by(F.lit("应不大于5MΩ"), F.lit("6MΩ"), F.lit("5GΩ"))).alias("slip"),
        textdiff.few_characters_differ(by(F.lit("abc"), _text("abcdefghijkl", n), F.lit("abcdefghijklmn")), by(F.lit("abd"), _text("abcdefghijkxy", n), F.lit("abcdefghijk"))).alias("few"),
        textdiff.lines_moved(lines, by(F.lit("第三行的内容第一行的内容第二行的内容"), F.lit("第二行的内容；第一行的内容；第三行的内容"), F.lit("第一行的内容第二行的内容第三行的内容"))).alias("moved"),
        F.when(k == 0, numbers.convert(big, F.lit("uA"), F.lit("A")).cast("double")).alias("amperes"),
    )
