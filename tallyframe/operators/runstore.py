"""Reads of a store of cases, documents, runs, findings and evidence; categories over runs; what keeps a run from publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: categories of findings by status and of ledger rows by disposition; run states without a result
STATUS_CATEGORY = {"pass": "automatic_match", "error": "confirmed_mismatch", "warning": "warning", "manual": "manual_review"}
DISPOSITION_CATEGORY = {"matched": "automatic_match", "mismatch": "confirmed_mismatch", "manual": "manual_review", "not_applicable": "not_applicable", "excluded": "excluded"}
CATEGORIES = ("automatic_match", "confirmed_mismatch", "warning", "manual_review", "not_applicable", "excluded")
WITHOUT_RESULT = ("missing", "invalid")
TERMINAL_RULES = ("succeeded", "not_applicable", "unsupported", "failed")


def _lookup(values: dict[str, str], c):
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def _counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def case_counts(cases: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Each case with its numbers of documents and runs."""
    out = cases.join(_counts(documents, "case_id", "document_count"), "case_id", "left").join(_counts(runs, "case_id", "run_count"), "case_id", "left")
    return out.fillna(0, ["document_count", "run_count"])


def list_cases(cases: DataFrame, text: str | None = None, limit: int = 25) -> DataFrame:
    """The cases changed last (1 to 100 of them), with ``text`` in their name or description where it is given."""
    if isinstance(limit, bool) or not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    wanted = (text or "").strip()
    rows = cases.where(F.contains(F.lower("name"), F.lit(wanted.lower())) | F.contains(F.lower("description"), F.lit(wanted.lower()))) if wanted else cases
    return rows.orderBy(F.desc("updated_at"), "case_id").limit(limit)


def case_runs(runs: DataFrame, cases: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs with the name of their case, the newest first; ``limit``: only so many."""
    out = runs.join(cases.select("case_id", F.col("name").alias("case_name")), "case_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return out if limit is None else out.limit(limit)


def waiting_runs(runs: DataFrame, limit: int) -> DataFrame:
    """Queued runs in the order in which they came."""
    return runs.where("state = 'queued'").orderBy("created_at", "run_id").limit(limit)


def documents_with_blobs(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Documents with size and path of their content; one without its blob has nulls."""
    return documents.join(blobs.select("sha256", "size", "path"), "sha256", "left")


def findings_with_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with an array of their evidence, ordered by its number; without any the array is empty."""
    parts = [c for c in evidence.columns if c != "finding_id"]
    first = ["evidence_id", *[c for c in parts if c != "evidence_id"]]
    nested = evidence.groupBy("finding_id").agg(F.sort_array(F.collect_list(F.struct(*first))).alias("evidence"))
    none = F.array().cast(nested.schema["evidence"].dataType)
    return findings.join(nested, "finding_id", "left").withColumn("evidence", F.coalesce("evidence", none))


def category_counts(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run_id, category, findings, ledger_rows), zeros left out.

    A passed finding takes the category of its ledger row where that is not applicable or
    excluded. ``findings`` has (run_id, status, disposition of the linked row or null).
    """
    passed = (F.col("status") == "pass") & F.col("disposition").isin("not_applicable", "excluded")
    f = findings.groupBy("run_id", F.when(passed, F.col("disposition")).otherwise(_lookup(STATUS_CATEGORY, F.col("status"))).alias("category")).agg(F.count(F.lit(1)).alias("findings"))
    rows = ledger.groupBy("run_id", _lookup(DISPOSITION_CATEGORY, F.col("disposition")).alias("category")).agg(F.count(F.lit(1)).alias("ledger_rows"))
    return f.join(rows, ["run_id", "category"], "full_outer").fillna(0, ["findings", "ledger_rows"]).where(F.col("category").isNotNull())


def category_totals(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """Sums of all categories over runs that have a result; every category has a row."""
    names = runs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    valid = runs.where(~F.col("run_state").isin(*WITHOUT_RESULT)).select("run_id")
    sums = counts.join(valid, "run_id", "left_semi").groupBy("category").agg(F.sum("findings").alias("findings"), F.sum("ledger_rows").alias("ledger_rows"))
    return names.join(sums, "category", "left").fillna(0)


def scope_coverage(ledger: DataFrame, scopes: DataFrame, statuses: tuple[str, ...] = ("pass", "warning", "manual", "error", "not_applicable", "excluded")) -> DataFrame:
    """Each scope with its ledger rows and their number by status; ``ledger`` has an array scope_ids."""
    rows = ledger.select(F.explode(F.array_distinct("scope_ids")).alias("scope_id"), "status")
    per = rows.groupBy("scope_id").agg(F.count(F.lit(1)).alias("eligible"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return scopes.join(per, "scope_id", "left").fillna(0, ["eligible", *statuses])


def publication_problems(runs: DataFrame, planned: DataFrame, executed: DataFrame, findings: DataFrame, evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run_id, problem) for whatever keeps a run from being published; no rows for a run that may be.

    ``runs``: run_id, mode, source_sha256, source_sha256_after. ``planned``: run_id, rule_id.
    ``executed``: run_id, rule_id, state, finding_count. ``findings``: run_id, finding_id,
    rule_id, status. ``evidence``: run_id, finding_id, role. ``ledger``: run_id,
    disposition, reported.
    """
    found: list[DataFrame] = []

    def problem(rows: DataFrame, name: str) -> None:
        found.append(rows.select("run_id").distinct().withColumn("problem", F.lit(name)))

    rule = ["run_id", "rule_id"]
    problem(planned.join(executed, rule, "left_anti"), "planned_rule_not_executed")
    problem(executed.join(planned, rule, "left_anti"), "executed_rule_not_planned")
    problem(executed.where(~F.coalesce(F.col("state").isin(*TERMINAL_RULES), F.lit(False))), "rule_not_terminal")
    counted = executed.join(_counts_by(findings, rule), rule, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    problem(counted.where("n <> coalesce(finding_count, 0)"), "finding_count_differs")
    problem(counted.where("state = 'succeeded' and n = 0"), "success_without_finding")
    problem(findings.groupBy("run_id", "finding_id").count().where("count > 1"), "finding_id_repeated")
    named = findings.join(runs.select("run_id", "mode"), "run_id")
    problem(named.where(~F.startswith("finding_id", F.concat("mode", F.lit(":")))), "finding_id_without_mode")
    roles = evidence.groupBy("run_id", "finding_id").agg(F.count_if(F.col("role") == "source").alias("s"), F.count_if(F.col("role") == "target").alias("t"))
    judged = findings.where(F.col("status").isin("manual", "error")).join(roles, ["run_id", "finding_id"], "left")
    problem(judged.where("coalesce(s, 0) = 0 or coalesce(t, 0) = 0"), "evidence_of_one_side_missing")
    problem(runs.where(~F.col("source_sha256").eqNullSafe(F.col("source_sha256_after"))), "source_changed")
    problem(ledger.where(~F.col("disposition").eqNullSafe(F.col("reported"))), "reported_disposition_differs")
    problem(runs.join(ledger.select("run_id").distinct(), "run_id", "left_anti"), "empty_coverage")
    return reduce(DataFrame.unionByName, found)


def _counts_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def overlapping_entries(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id) of ledger entries of two runs that share a source or a target row; both have (id, side, row_id)."""
    return new.select(F.col("id").alias("new_id"), "side", "row_id").join(old.select(F.col("id").alias("old_id"), "side", "row_id"), ["side", "row_id"]).select("new_id", "old_id").distinct()
