"""Coverage ledgers: conservation, rollups, publication checks, run diffs, gold answers, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.status import DISPOSITION_RANK, REVIEW_OUTCOMES, STATUS_RANK, rank_of, worst
from tallyframe.operators.sequences import latest

DISPOSITIONS = tuple(DISPOSITION_RANK)


class CoverageError(ValueError):
    """A ledger that doesn't account for its rows."""


def coverage(eligible: DataFrame, ledger: DataFrame, side: str) -> DataFrame:
    """One row: eligible, accounted, missing, unknown, repeated ids of one side, and conserved.

    ``eligible`` has the column ``side`` with the ids; ``ledger`` has it too, nullable.
    """
    have = eligible.groupBy(side).agg(F.count(F.lit(1)).alias("__e"))
    seen = ledger.where(F.col(side).isNotNull()).groupBy(side).agg(F.count(F.lit(1)).alias("__l"))
    both = have.join(seen, side, "full_outer")
    out = both.agg(
        F.coalesce(F.sum("__e"), F.lit(0)).alias("eligible"),
        F.count_if(F.col("__e").isNotNull() & F.col("__l").isNotNull()).alias("accounted"),
        F.count_if(F.col("__l").isNull()).alias("missing"),
        F.count_if(F.col("__e").isNull()).alias("unknown"),
        F.count_if(F.col("__e") > 1).alias("repeated"),
    )
    return out.withColumn("conserved", (F.col("eligible") == F.col("accounted")) & (F.col("missing") + F.col("unknown") + F.col("repeated") == 0))


def require_coverage(eligible_source: DataFrame, eligible_target: DataFrame, ledger: DataFrame, source: str = "source_row_id", target: str = "target_row_id") -> dict[str, int]:
    """Raise unless both sides are conserved, no edge is empty or repeated and every disposition is known."""
    problems = []
    counts: dict[str, int] = {}
    for frame, side in ((eligible_source, source), (eligible_target, target)):
        r = coverage(frame, ledger, side).first()
        counts[side] = r.eligible
        if not r.conserved:
            problems.append(f"{side}: {r.eligible} eligible, {r.accounted} accounted, {r.missing} missing, {r.unknown} unknown, {r.repeated} repeated")
    edges = ledger.groupBy(source, target).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("disposition"), F.lit("")).isin(*DISPOSITIONS)).alias("odd"))
    r = edges.agg(F.count_if(F.col(source).isNull() & F.col(target).isNull()).alias("empty"), F.count_if(F.col("n") > 1).alias("twice"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), F.count(F.lit(1)).alias("edges")).first()
    problems += [f"{n} {what}" for n, what in ((r.empty, "empty edges"), (r.twice, "repeated edges"), (r.odd, "unknown dispositions")) if n]
    if not r.edges:
        problems.append("an empty ledger can't be published")
    if problems:
        raise CoverageError("; ".join(problems))
    return counts


def row_dispositions(ledger: DataFrame, side: str) -> DataFrame:
    """The worst disposition of each row over its edges."""
    return ledger.where(F.col(side).isNotNull()).groupBy(side).agg(worst(F.col("disposition"), DISPOSITION_RANK).alias("disposition"))


def counts_by(df: DataFrame, column: str, values: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(v) for v in values]


def overall_status(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: the worst of findings and ledger, nothing at all being manual."""
    f = findings.agg(F.max(rank_of(F.col("status"), STATUS_RANK)).alias("f"))
    as_status = F.when(F.col("disposition") == "mismatch", 3).when(F.col("disposition") == "manual", 2).otherwise(0)
    top = F.greatest("f", "l")
    names = F.array(*[F.lit(s) for s in STATUS_RANK])
    return f.join(F.broadcast(ledger.agg(F.max(as_status).alias("l")))).select(F.coalesce(F.try_element_at(names, top + 1), F.lit("manual")).alias("overall"))


def degree_class(ledger: DataFrame, source: str = "source_row_id", target: str = "target_row_id") -> DataFrame:
    """Edges with 1:1, 1:n, n:1 or n:m by how often their ends occur."""
    s = ledger.groupBy(source).agg(F.count(F.lit(1)).alias("__s"))
    t = ledger.groupBy(target).agg(F.count(F.lit(1)).alias("__t"))
    many = lambda c: F.when(F.col(c) > 1, "n").otherwise("1")
    kind = F.when((F.col("__s") > 1) & (F.col("__t") > 1), "n:m").otherwise(F.concat(many("__t"), F.lit(":"), many("__s")))
    return ledger.join(s, source).join(t, target).withColumn("degree", kind).drop("__s", "__t")


def run_diff(base: DataFrame, current: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of two runs with a change category.

    Runs have (keys, decision, reason); gold has (keys, expected, acceptable array).
    A decided entry that changes is a regression unless the gold answer agrees.
    """
    b = base.select(*keys, F.col("decision").alias("before"), F.col("reason").alias("before_reason"), F.lit(True).alias("__b"))
    c = current.select(*keys, F.col("decision").alias("after"), F.col("reason").alias("after_reason"), F.lit(True).alias("__c"))
    j = b.join(c, keys, "full_outer").join(gold.select(*keys, "expected", "acceptable"), keys, "left")
    agrees = F.coalesce((F.col("after") == F.col("expected")) | F.array_contains("acceptable", F.col("after")), F.lit(False))
    same = F.col("before").eqNullSafe(F.col("after"))
    category = (
        F.when(same & ~F.col("before_reason").eqNullSafe(F.col("after_reason")), "reason_only")
        .when(same, "unchanged")
        .when(F.col("before").isin("matched", "mismatch"), F.when(agrees, "explained").otherwise("regression"))
        .when(F.col("__b").isNull(), "added")
        .when(F.col("__c").isNull(), "removed")
        .otherwise("other")
    )
    return j.withColumn("category", category).drop("__b", "__c", "acceptable")


def gold_category(expected: Column, actual: Column) -> Column:
    """How an answer misses the gold one; ok if it doesn't."""
    return (
        F.when(expected.eqNullSafe(actual), "ok")
        .when(expected.isNull(), "no_answer")
        .when(actual.isNull(), "entry_gone")
        .when(expected == "mismatch", F.when(actual == "manual", "missed_to_manual").otherwise("missed"))
        .when(expected == "matched", F.when(actual == "mismatch", "false_alarm").when(actual == "manual", "extra_manual").otherwise("scope"))
        .when(expected == "manual", F.when(actual == "matched", "wrongly_passed").when(actual == "excluded", "scope").otherwise("other"))
        .otherwise("scope")
    )


def merge_answers(gold: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Gold with reviewed answers put in for keys it has; others are left out."""
    r = latest(reviewed, keys, ["created_at"]).select(*keys, F.col("expected").alias("__new"))
    return gold.join(r, keys, "left").withColumn("expected", F.coalesce("__new", "expected")).drop("__new")


def effective_reviews(actions: DataFrame) -> DataFrame:
    """The latest action of each finding, as its outcome; a withdrawn one has none."""
    last = latest(actions.select("finding_id", "revision", "action"), ["finding_id"], ["revision"])
    outcome = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in REVIEW_OUTCOMES.items() if v[i] for x in (k, v[i])]), F.col("action"))
    return last.where("action <> 'withdraw'").select("finding_id", "action", outcome(0).alias("outcome"), outcome(1).alias("status"))


def validate_import(manifest: DataFrame, rows: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Problems of an imported review: missing, unknown, repeated or modified rows."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    m = manifest.select(key, F.struct(*fixed).alias("m"))
    j = m.join(n, key, "full_outer").join(rows.select(key, F.struct(*fixed).alias("r")), key, "left")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("m").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(~F.col("m").eqNullSafe(F.col("r")), "modified")
    return j.select(key, problem.alias("problem")).where("problem is not null").distinct()
