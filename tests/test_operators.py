import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ledger, matching, sequences
from tallyframe.sources import readers, writers


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


LEDGER = "source_row_id string, target_row_id string, disposition string, reason_code string"


def sides(spark):
    s = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source_row_id string")
    t = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "target_row_id string")
    good = spark.createDataFrame([("s1", "t1", "matched", "x"), ("s1", "t2", "mismatch", "x"), ("s2", None, "excluded", "x"), ("s3", None, "manual", "x"), (None, "t3", "mismatch", "x")], LEDGER)
    return s, t, good


def test_coverage_is_conserved_or_refused(spark):
    s, t, good = sides(spark)
    assert ledger.require_coverage(s, t, good) == {"source_row_id": 3, "target_row_id": 3}
    assert rows(ledger.row_dispositions(good, "source_row_id"), "source_row_id", "disposition") == [("s1", "mismatch"), ("s2", "excluded"), ("s3", "manual")]
    for bad in (good.where("source_row_id <> 's3'"), good.unionByName(spark.createDataFrame([("s9", None, "manual", "x")], LEDGER)), good.unionByName(spark.createDataFrame([(None, None, "manual", "x")], LEDGER)), good.unionByName(good.limit(1)), good.withColumn("disposition", F.lit("odd")), good.limit(0)):
        with pytest.raises(ledger.CoverageError):
            ledger.require_coverage(s, t, bad)
    with pytest.raises(ledger.CoverageError):
        ledger.require_coverage(s.unionByName(s.limit(1)), t, good)
    assert rows(ledger.degree_class(good.where("source_row_id is not null and target_row_id is not null")), "degree") == [("1:n",), ("1:n",)]


def test_publish_is_all_or_nothing(spark, tmp_path):
    s, t, good = sides(spark)
    findings = spark.createDataFrame([("f1", "error"), ("f2", "pass")], "finding_id string, status string")
    with pytest.raises(ledger.CoverageError):
        writers.publish("r0", good.limit(2), findings, s, t, str(tmp_path))
    assert not list(tmp_path.iterdir())
    writers.publish("r1", good, findings, s, t, str(tmp_path))
    writers.publish("r2", good, findings, s, t, str(tmp_path))
    good.withColumn("run_id", F.lit("lost")).write.mode("append").partitionBy("run_id").parquet(f"{tmp_path}/ledger")
    assert rows(writers.published(spark, str(tmp_path), "ledger").groupBy("run_id").count(), "run_id", "count") == [("r1", 5), ("r2", 5)]


def test_overall_status(spark):
    f = spark.createDataFrame([("pass",), ("warning",)], "status string")
    none = f.limit(0)
    entries = lambda *d: spark.createDataFrame([(x,) for x in d], "disposition string")
    status = lambda a, b: ledger.overall_status(a, b).first()[0]
    assert (status(f, entries("matched")), status(f, entries("manual")), status(none, entries("mismatch")), status(none, entries().limit(0))) == ("warning", "manual", "error", "manual")


def test_tiers_leave_ambiguity_to_no_one(spark):
    s = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "c", "X"), (4, "d", "X"), (5, None, None)], "s int, k string, m string")
    t = spark.createDataFrame([(10, "a", "A"), (20, "z", "B"), (30, "y", "X"), (50, None, None)], "t int, k string, m string")
    got = matching.tiered(s, t, "s", "t", [("k", F.col("k"), F.col("k")), ("m", F.col("m"), F.col("m"))])
    assert rows(got, "s", "t", "tier") == [(1, 10, "k"), (2, 20, "m")]


def test_as_of_before_and_at(spark):
    e = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    v = spark.createDataFrame([(1, 10, "a"), (1, 15, "b")], "k int, at int, v string")
    assert rows(matching.as_of(e, v, ["k"], "t", "at", "v"), "k", "t", "asof_v") == [(1, 10, "a"), (1, 20, "b"), (2, 5, None)]
    assert rows(matching.as_of(e, v, ["k"], "t", "at", "v", strict=True), "k", "t", "asof_v") == [(1, 10, None), (1, 20, "b"), (2, 5, None)]


def test_references_containment_and_boxes(spark):
    items = spark.createDataFrame([(1, "见第2至4"), (5, "序号 7"), (6, None)], "i int, t string")
    assert rows(matching.expand_references(items, "i", "t"), "i", "referred") == [(1, 2), (1, 3), (1, 4), (5, 7)]
    needles = spark.createDataFrame([(1, "b c d"), (2, "xy"), (3, "a  b"), (4, "zz zz")], "n int, needle string")
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "wxyz"), (3, "a  b"), (4, None)], "d int, text string")
    assert rows(matching.contained(needles, "n", "needle", docs, "d", "text"), "n", "d") == [(1, 1), (2, 2), (3, 3)]
    points = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 1, 1.2, 1.0), (1, 1, 11.0, 1.0), (1, 2, 1.0, 1.0), (1, 2, 11.0, 1.0)], "page int, s int, x double, y double")
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 2.0, 2.0), (1, "b", 10.0, 0.0, 12.0, 2.0)], "page int, b string, x0 double, y0 double, x1 double, y1 double")
    assert rows(matching.page_hits(points, boxes, "page", "s", "b"), "s", "b", "ambiguous") == [(1, "a", False), (2, "a", True)]


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 5), (2, 2)], "g int, n int")
    got = {r.g: (r.first, r.last, r.missing, r.repeated) for r in sequences.gaps(df, "g", "n").collect()}
    assert got == {1: (1, 5, [3, 4], [2]), 2: (2, 2, [1], [])}
    assert rows(sequences.range_text(df, "g", "n"), "g", "ranges") == [(1, "1-2,5"), (2, "2")]
    assert rows(sequences.occurrence_keys(df, ["g", "n"], ["n"]), "key") == [("1-1",), ("1-2#1",), ("1-2#2",), ("1-5",), ("2-2",)]
    filled = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "b")], "g int, n int, v string")
    assert rows(sequences.fill_down(filled, ["g"], ["n"], ["v"], F.col("n") == 3), "n", "v") == [(1, "a"), (2, "a"), (3, None), (4, "b")]
    assert rows(sequences.next_value(filled, ["g"], ["n"], F.col("v").isNotNull(), "n", "after"), "n", "after") == [(1, 2), (2, None), (3, None), (4, None)]
    starts = spark.createDataFrame([([10.0, 1.0, 3.0, 4.5, 12.0],)], "p array<double>").select(sequences.clusters_from_start(F.col("p"), 3.0).alias("c"))
    assert starts.first().c == [1.0, 4.5, 10.0]


def test_row_lines_without_position_come_last(spark):
    df = spark.createDataFrame([(1, 100), (1, None), (1, 5), (1, 130), (1, 5), (1, None), (1, 100), (2, None), (None, 7)], "g int, n int")
    got = sorted(((r.g, r.n, r.line) for r in sequences.row_lines(df, ["g"], "n", 60).collect()), key=str)
    want = [(1, 5, 1), (1, 5, 1), (1, 100, 2), (1, 100, 2), (1, 130, 2), (1, None, 3), (1, None, 4), (2, None, 1), (None, 7, 1)]
    assert got == sorted(want, key=str)


def test_run_diff_and_gold(spark):
    run = lambda *r: spark.createDataFrame(r, "k string, decision string, reason string")
    base = run(("a", "matched", "x"), ("b", "matched", "x"), ("c", "mismatch", "x"), ("d", "manual", "x"), ("e", "manual", "x"), ("f", "manual", "x"))
    now = run(("a", "matched", "x"), ("b", "matched", "y"), ("c", "matched", "x"), ("d", "matched", "x"), ("f", "manual", "x"), ("g", "manual", "x"))
    gold = spark.createDataFrame([("c", "matched", [])], "k string, expected string, acceptable array<string>")
    got = {r.k: r.category for r in ledger.run_diff(base, now, gold, ["k"]).collect()}
    assert got == {"a": "unchanged", "b": "reason_only", "c": "explained", "d": "other", "e": "removed", "f": "unchanged", "g": "added"}
    assert {r.k: r.category for r in ledger.run_diff(base, now, gold.limit(0), ["k"]).collect()}["c"] == "regression"
    pairs = [("mismatch", "manual"), ("mismatch", "matched"), ("matched", "mismatch"), ("matched", "manual"), ("manual", "matched"), ("manual", "excluded"), ("excluded", "matched"), ("matched", "matched"), (None, "manual"), ("manual", None)]
    df = spark.createDataFrame(pairs, "e string, a string").select(ledger.gold_category(F.col("e"), F.col("a")))
    assert [r[0] for r in df.collect()] == ["missed_to_manual", "missed", "false_alarm", "extra_manual", "wrongly_passed", "scope", "scope", "ok", "no_answer", "entry_gone"]


def test_reviews(spark):
    actions = spark.createDataFrame([("f1", 1, "confirm_candidate"), ("f1", 2, "withdraw"), ("f2", 1, "record_observation"), ("f3", 1, "confirm_candidate")], "finding_id string, revision int, action string")
    assert rows(ledger.effective_reviews(actions), "finding_id", "outcome", "status") == [("f2", "indeterminate", "manual"), ("f3", "consistent", "warning")]
    manifest = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    back = spark.createDataFrame([("a", 1), ("b", 9), ("d", 1)], "k string, v int")
    assert rows(ledger.validate_import(manifest, back, "k", ["v"]), "k", "problem") == [("b", "modified"), ("c", "missing"), ("d", "unknown")]
    gold = spark.createDataFrame([("a", "matched"), ("b", "manual")], "k string, expected string")
    new = spark.createDataFrame([("b", "matched", 1), ("b", "mismatch", 2), ("z", "matched", 1)], "k string, expected string, created_at int")
    assert rows(ledger.merge_answers(gold, new, ["k"]), "k", "expected") == [("a", "matched"), ("b", "mismatch")]


def test_run_results_have_a_validity_class(spark, tmp_path):
    ok = {"mode": "m", "sample": "A", "findings": [], "ledger": [{"entry_id": "1", "disposition": "matched"}], "coverage": {"source_rows": {"eligible": 1, "accounted": 1, "conserved": True}, "report_rows": {"eligible": 1, "accounted": 1, "conserved": True}}}
    for name, body in (("a", json.dumps(ok)), ("b", json.dumps({"mode": "m", "sample": "B"})), ("c", "{not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(body)
    got = readers.run_results(spark, f"{tmp_path}/*/result.json").cache()
    assert sorted(r.validity for r in got.collect()) == ["complete", "incomplete", "invalid"]
    expected = spark.createDataFrame([("m", "A"), ("m", "Z")], "mode string, sample string")
    assert rows(readers.with_expected(got, expected), "sample", "validity") == [("A", "complete"), ("Z", "missing")]
    assert rows(readers.blobs(spark, str(tmp_path)), "copies") == [(1,), (1,), (1,)]
    assert writers.manifest(spark, str(tmp_path)).count() == 3


def test_tables_and_clauses(spark):
    cells = spark.createDataFrame(
        [("d", 1, 0, 0, 0, "序号", 10.0), ("d", 1, 0, 0, 1, "结果", 50.0), ("d", 2, 0, 0, 0, "1", 11.0), ("d", 2, 0, 0, 1, "ok", 48.5), ("d", 3, 0, 0, 0, "1", 30.0)],
        "doc_id string, page int, table_idx int, row_idx int, col_idx int, text string, x0 double",
    )
    assert rows(readers.table_rows(cells.where("page = 2")), "cells") == [(["1", "ok"],)]
    template = cells.where("page = 1").select("doc_id", F.col("text").alias("title"), "x0")
    got = readers.continuation_columns(cells.where("page > 1"), template)
    assert rows(got, "page", "col_idx", "title") == [(2, 0, "序号"), (2, 1, "结果")]
    header = cells.where("page = 1").withColumn("page", F.lit(2))
    assert rows(readers.aligned_cells(cells.where("page = 2"), header), "text", "title") == [("1", "序号"), ("ok", "结果")]
    lines = spark.createDataFrame([("d", 1, "cover"), ("d", 2, "2.1 Title"), ("d", 3, " body"), ("d", 4, "2.2 Next")], "doc_id string, n int, text string")
    assert rows(readers.clause_nodes(lines), "clause_id", "text", "is_heading_only") == [("2.1", "Title\nbody", False), ("2.2", "Next", True)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f1", "matched", "n,1", "r")], readers.REVIEW)
    writers.review_csv(df.withColumn("pages", F.array(F.lit(1))), f"{tmp_path}/x")
    assert spark.read.option("header", True).csv(f"{tmp_path}/x").first().pages == "[1]"
    writers.review_csv(df, f"{tmp_path}/y")
    assert readers.review_rows(spark, f"{tmp_path}/y").first().note == "n,1"
    findings = spark.createDataFrame([("r", "f1", "pass", "R1"), ("r", "f2", "error", "R2"), ("r", "f3", "error", "R1")], "run_id string, finding_id string, status string, rule_id string")
    plan = spark.createDataFrame([("R1", 1), ("R2", 2)], "rule_id string, plan_order int")
    assert rows(writers.display_order(findings, plan), "display_sequence", "finding_id") == [(1, "f3"), (2, "f2"), (3, "f1")]
