from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import clauses, dates, geometry, numbers, status, text, textdiff
from tallyframe.functions.binding import let


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__i int, " + schema).select(F.struct("*").alias("r")).select("r.*").select(column.alias("v"), "__i").orderBy("__i").collect()]


@pytest.mark.parametrize(
    ("value", "unit", "target", "context", "side", "decision"),
    [
        ("509", "uA", "0.5", "mA", None, "match"),
        ("509", "uA", "0.51", "mA", None, "match"),
        ("509", "uA", "0.52", "mA", None, "mismatch"),
        ("910.2", "μA", "0.91 mA", None, None, "match"),
        ("9", "uA", "＜0.01 mA", None, None, "match"),
        ("10", "uA", "＜0.01 mA", None, None, "mismatch"),
        ("400", "uA", "[0.5, 1.0]mA", None, None, "mismatch"),
        ("500", "uA", "[0.5, 1.0]mA", None, None, "match"),
        ("1000", "uA", "[0.5, 1.0]mA", None, None, "match"),
        ("500", "uA", "(0.5mA,1.0mA]", None, None, "mismatch"),
        ("501", "uA", "(0.5mA,1.0mA]", None, None, "match"),
        ("0.7", "mA", "0.5~1.0mA", None, None, "manual"),
        ("0.7", "mA", "0.7±0.1 mA", None, None, "manual"),
        ("0.5", "mA", "0.5mA(−)", None, None, "manual"),
        ("0.5", "mA", "0.5mA(−)", None, "−", "match"),
        ("0.5", "mA", "0.5mA(−)", None, "+", "mismatch"),
        ("0.5", "V", "0.5mA", None, None, "manual"),
        ("5", "mA", "see note", None, None, "manual"),
        ("5", "MΩ", "5000000 Ω", None, None, "match"),
        ("2", "pF", "0.000002 uF", None, None, "match"),
    ],
)
def test_observations(spark, value, unit, target, context, side, decision):
    verdict = let(numbers.parse_constraint(F.col("t"), F.col("c")), lambda c: numbers.compare_with(c, numbers.decimal_value(F.col("v")), F.col("u"), F.col("s")))
    assert values(spark, [(value, unit, target, context, side)], "v string, u string, t string, c string, s string", verdict["decision"]) == [decision]


def test_conversion_is_exact_and_refuses_other_dimensions(spark):
    rows = [("509", "uA", "mA"), ("509", "µA", "mA"), ("0.5", "mA", "uA"), ("1", "mA", "V"), ("1", None, None), ("1", "x", "x"), ("true", "A", "A"), ("5", "nA", "kA")]
    got = values(spark, rows, "v string, a string, b string", numbers.convert(numbers.decimal_value(F.col("v")), F.col("a"), F.col("b")))
    assert got[:3] == [Decimal("0.509"), Decimal("0.509"), Decimal("500")] and got[3] is None and got[4] == 1 and got[5] == 1 and got[6] is None
    assert got[7] == Decimal("0.000000000005")


def test_rounding_half_up_by_row(spark):
    rows = [("0.005", 2), ("0.004", 2), ("-0.125", 2), ("2.5", 0)]
    got = values(spark, rows, "v string, p int", numbers.round_half_up(numbers.decimal_value(F.col("v")), F.col("p")))
    assert got == [Decimal("0.01"), Decimal("0"), Decimal("-0.13"), Decimal("3")]


def test_percentages(spark):
    rows = [("-5%~+4%", "-4%~+4%"), ("1% 改为 2%", "2%"), ("0.3%", "none"), ("none", "none"), ("1% 2%", "1%, 2%")]
    assert values(spark, rows, "a string, b string", numbers.compare_percentages(F.col("a"), F.col("b"))["reason"]) == ["percentage_mismatch", "percentage_copied", "report_percentage_missing", "percentage_missing_both_sides", "percentage_copied"]


def test_largest_observation(spark):
    rows = [([("500", "uA"), ("0.7", "mA")], "mA"), ([("500", "uA")], None), ([("1", "uA"), ("2", "V")], "mA"), ([], "mA")]
    items = F.transform("o", lambda x: F.struct(numbers.decimal_value(x["v"]).alias("value"), x["u"].alias("unit")))
    got = values(spark, rows, "o array<struct<v: string, u: string>>, t string", numbers.largest_observation(items, F.col("t")))
    assert [r.decision for r in got] == ["match", "manual", "manual", "manual"] and got[0].converted == Decimal("0.7")


def test_result_kinds_and_points(spark):
    assert values(spark, [("0.5 mA",), ("1~2 mA",), ("ok",), ("<3",)], "t string", numbers.result_kind(F.col("t"))) == ["scalar", "range", "none", "scalar"]
    assert values(spark, [("123",), ("1",)], "t string", numbers.point_variants(F.col("t"))) == [["1.23", "12.3"], []]


def test_status_words(spark):
    rows = [("符合", "-"), ("不适用", "/"), ("合格", "符合要求"), ("符合", "0.5"), ("不符合", "")]
    assert values(spark, rows, "s string, r string", status.compare_status(F.col("s"), F.col("r"), status.STATUS_WORDS)["decision"]) == ["mismatch", "match", "manual", "match", "mismatch"]
    rows = [("/", "——"), ("△", "/"), ("", "——"), ("√", "符合要求")]
    assert values(spark, rows, "s string, r string", status.compare_status(F.col("s"), F.col("r"), status.STATUS_SIGNS)["decision"]) == ["mismatch", "match", "manual", "match"]


def test_conclusions(spark):
    rows = [(["——", "/"],), (["——", "0.3"],), (["符合要求", "——"],), (["符合要求", "不符合要求"],), ([],)]
    assert values(spark, rows, "r array<string>", status.conclusion_of_results(F.col("r"))) == ["/", "符合", "符合", "不符合", status.MISSING_RESULT]
    rows = [(["√", "×"],), (["△", "/"],), (["其他"],), ([],)]
    assert values(spark, rows, "r array<string>", status.conclusion_of_statuses(F.col("r"), status.STATUS_SIGNS)) == ["不符合", "/", None, None]
    rows = [(["符合", "不适用"],), (["不适用", "不适用"],), (["不符合", "符合"],)]
    assert values(spark, rows, "r array<string>", status.conclusion_of_statuses(F.col("r"), status.STATUS_WORDS)) == ["符合", "/", "不符合"]
    rows = [(["mismatch", "manual"],), (["manual"],), (["match", "match"],), ([],)]
    assert values(spark, rows, "r array<string>", status.verdict_of(F.col("r"))) == ["error", "manual", "pass", "manual"]


def test_transitions(spark):
    rows = [(None, "queued"), (None, "running"), ("queued", "running"), ("succeeded", "running"), ("odd", "running")]
    assert values(spark, rows, "a string, b string", status.transition_ok(F.col("a"), F.col("b"), status.LIFECYCLE, "queued")) == [True, False, True, False, False]


def test_clauses(spark):
    one = lambda rows, column, schema="a string, b string": values(spark, rows, schema, column)
    assert one([("2．4.1 a)",), ("2.10.",)], clauses.canonical(F.col("a")), "a string") == ["2.4.1a", "2.10"]
    assert one([("2.4.1a", "2.4.1"), ("2.4.10", "2.4.1"), ("2.4.1.2", "2.4"), ("2.4", "2.4"), ("2.40", "2.4")], clauses.is_within(F.col("a"), F.col("b"))) == [True, False, True, True, False]
    assert one([("2.1", "2.3"), ("2.4.1a", "c"), ("2.3", "2.1"), ("2.1", "3.2"), ("1", "3")], clauses.expand_range(F.col("a"), F.col("b"))) == [["2.1", "2.2", "2.3"], ["2.4.1a", "2.4.1b", "2.4.1c"], None, None, ["1", "2", "3"]]
    assert one([("2.9", "2.10"), ("2.9", "2.11"), ("2.9", "3.10")], clauses.is_next(F.col("a"), F.col("b"))) == [True, False, False]
    assert one([("2.4.1a",), ("2.4",), ("2",)], clauses.ancestors(F.col("a")), "a string") == [["2.4.1", "2.4", "2"], ["2"], []]
    assert one([("2.4.1a",), ("2.4",), ("2",)], clauses.parent(F.col("a")), "a string") == ["2.4.1", "2", None]
    assert one([("2.3", "x"), ("2.3.4", "x"), ("2.5", "x"), ("3.3", "x")], clauses.in_range(F.col("a"), F.lit("2.2"), F.lit("2.4"))) == [True, True, False, False]


def test_scopes(spark):
    got = clauses.scope_of("2.1～2.3、2.4.1a)～c)（除2.4.1b外）")
    assert got["included"] == ["2.1", "2.2", "2.3", "2.4.1a", "2.4.1b", "2.4.1c"] and got["excluded"] == ["2.4.1b"] and got["status"] == "parsed"
    bad = clauses.scope_of("2.1、附录")
    assert bad["status"] == "manual" and bad["unresolved"] == ["附录"] and bad["included"] == ["2.1"]
    assert clauses.scope_of("2.4.1a、b、2.6（仅检2.6.1）")["only"] == ["2.6.1"] and clauses.scope_of("2.4.1a、b")["included"] == ["2.4.1a", "2.4.1b"]
    assert clauses.scope_of(None)["status"] == "manual"
    parsed = values(spark, [("2.1~2.3",)], "t string", clauses.parse_scope(F.col("t")))
    assert parsed[0].included == ["2.1", "2.2", "2.3"]
    rows = [("2.1.4", ["2.1"], ["2.1.4"]), ("2.1.5", ["2.1"], ["2.1.4"]), ("3", ["2.1"], [])]
    assert values(spark, rows, "c string, i array<string>, e array<string>", clauses.scope_decision(F.col("c"), F.col("i"), F.col("e"))) == ["excluded", "included", "out_of_scope"]


def test_dates(spark):
    rows = [("2024-02-30",), ("2024.02.28",), ("20240228",), ("2024年02月28日",), ("2024/2/8",), (None,)]
    assert values(spark, rows, "t string", dates.format_label(F.col("t"))) == [None, "YYYY.MM.DD", "YYYYMMDD", "YYYY年MM月DD日", None, None]
    assert [str(d) for d in values(spark, [("2024年2月8日",), ("2024年02月8日",), ("2024年13月1日",)], "t string", dates.strict_chinese(F.col("t")))] == ["2024-02-08", "None", "None"]
    rows = [("2024-02-28", "2024.02.28"), ("2024-02-28", "2024-02-28"), ("2024-02-28", "2024-02-27"), ("x", "2024-02-27")]
    assert values(spark, rows, "a string, b string", dates.compare_dates(F.col("a"), F.col("b"))) == ["format", "match", "mismatch", "manual"]


def test_text(spark):
    assert values(spark, [(" a\t　b\n",), (None,)], "t string", text.compact(F.col("t"))) == ["ab", ""]
    assert values(spark, [("Ａ，b。",)], "t string", text.comparison_text(F.col("t"))) == ["A,b"]
    assert values(spark, [("l2 V Ω", "x"), ("lamp", "x")], "t string, u string", text.locator_text(F.col("t"))) == ["12vω", "lamp"]
    assert values(spark, [("见GB 9706.1-2020与表 3",)], "t string", text.standards_in(F.col("t"))) == [["GB9706.1-2020"]]
    assert values(spark, [("见表 3、表1",)], "t string", text.tables_in(F.col("t"))) == [["1", "3"]]
    assert values(spark, [("(单位：mA)",), ("none",)], "t string", text.unit_context(F.col("t"))) == ["mA", None]
    assert values(spark, [("（a)", "x"), ("(a)", "x")], "t string, u string", text.has_mixed_brackets(F.col("t"))) == [True, False]
    assert values(spark, [("甲（乙）", "甲(乙)"), ("甲", "甲"), ("甲", "乙")], "a string, b string", text.name_relation(F.col("a"), F.col("b"))) == ["bracket_width", "same", "different"]
    assert values(spark, [("第3页，共9页",), ("3/9",), ("three",), ("",)], "t string", text.is_page_counter(F.col("t"))) == [True, True, False, False]
    assert values(spark, [("a\n注：b\nc",)], "t string", text.split_auxiliary_lines(F.col("t"))["main"]) == ["a\nc"]
    assert values(spark, [(["序号 ", "结果"],)], "h array<string>", text.is_result_table(F.col("h"), ["序号", "结果"])) == [True]
    assert values(spark, [(["a", "序号 "],)], "h array<string>", text.header_positions(F.col("h"), ["序号", "结果"])) == [{"序号": 1, "结果": -1}]


def test_text_differences(spark):
    assert textdiff.wording_of("裂纹等缺陷", "裂纹缺陷") == [{"op": "delete", "left": "等", "right": ""}]
    assert textdiff.wording_of("相同", "相同") == []
    assert textdiff.equivalence_of("- 一、二。", "一二") == "bullets" and textdiff.equivalence_of("1.5mm", "15mm") is None
    assert textdiff.equivalence_of("a, b.", "ab") == "punctuation" and textdiff.equivalence_of("a\nb", "b\na") == "line_order"
    assert textdiff.slips_of("5士1", "5±1") and not textdiff.slips_of("6MΩ", "5MΩ") and not textdiff.slips_of("5GΩ", "5MΩ")
    assert textdiff.facts_of("0.5mA") == textdiff.facts_of("500μA") and textdiff.facts_of("1N·m") == textdiff.facts_of("100N·cm")
    assert textdiff.facts_of("5MΩ") != textdiff.facts_of("5mΩ")
    assert textdiff.facts_of("60000000mm3") == [{"op": "=", "value": "0.06", "unit": "m^3"}]
    assert values(spark, [("abcd", "abcf"), (None, "x")], "a string, b string", textdiff.ratio(F.col("a"), F.col("b"))) == [0.75, None]
    assert values(spark, [(["abcd", "efgh"], "abcdefgh"), (["efgh", "abcd"], "abcdefgh"), (["abcd"], "abcd" * 2)], "p array<string>, c string", textdiff.ordered_containment(F.col("p"), F.col("c"))) == [True, False, False]
    got = values(spark, [("a 1 b", "a 2 b")], "a string, b string", textdiff.segments(F.col("a"), F.col("b")))
    assert [(s.left, s.right) for s in got[0]] == [("1", "2")]


def test_geometry(spark):
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(1.0).alias("y1"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = [(-1.0, 0.5, 3.0, 0.5), (-1.0, 2.0, 3.0, 2.0), (1.0, -1.0, 1.0, 3.0), (-1.0, -1.0, -0.5, 3.0), (0.5, 0.5, 0.6, 0.6), (-1.0, 0.0, 0.0, 3.0)]
    assert values(spark, rows, "a double, b double, c double, d double", geometry.segment_hits(point("a", "b"), point("c", "d"), box)) == [True, False, True, False, True, False]
    assert values(spark, [(5.0, 5.0), (1.0, 0.5)], "a double, b double", geometry.distance(point("a", "b"), box)) == [5.0, 0.0]
    stroke = F.transform("p", lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    rows = [([[-1.0, 0.5], [3.0, 0.5]],), ([[5.0, 5.0]],)]
    assert values(spark, rows, "p array<array<double>>", geometry.stroke_touches(stroke, box)) == [True, False]
    assert values(spark, rows, "p array<array<double>>", geometry.path_length(stroke)) == [4.0, 0.0]
    rows = [(0.0, 0.0, 2.0, 2.0)]
    other = (F.struct(F.lit(0.0).alias("x"), F.lit(2.0).alias("y")), F.struct(F.lit(2.0).alias("x"), F.lit(0.0).alias("y")))
    assert values(spark, rows, "a double, b double, c double, d double", geometry.segments_cross(point("a", "b"), point("c", "d"), *other)) == [True]
