"""Verdict vocabularies, their order, and mappings between status words and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.numbers import verdict
from tallyframe.functions.text import CONFORMING, NONCONFORMING, PLACEHOLDERS, compact, is_actual_result

# fixed values: ranks of dispositions and of machine statuses
DISPOSITION_RANK = {"excluded": 0, "not_applicable": 1, "matched": 2, "manual": 3, "mismatch": 4}
STATUS_RANK = {"pass": 0, "warning": 1, "manual": 2, "error": 3}
# fixed values: what a source status word asks of the result; None: conforming or any measured value
STATUS_WORDS = {"符合": None, "不符合": NONCONFORMING, "不适用": "——"}
STATUS_SIGNS = {"√": None, "×": NONCONFORMING, "△": "——", "/": "/"}
# fixed values: legal next states
LIFECYCLE = {
    "queued": ["running", "failed", "cancelled"],
    "running": ["succeeded", "failed", "cancel_requested", "interrupted"],
    "cancel_requested": ["cancelled", "failed", "interrupted"],
    "succeeded": [],
    "failed": [],
    "cancelled": [],
    "interrupted": [],
}
RULE_LIFECYCLE = {
    "pending": ["running", "succeeded", "not_applicable", "unsupported", "failed"],
    "running": ["succeeded", "not_applicable", "unsupported", "failed"],
    "succeeded": [],
    "not_applicable": [],
    "unsupported": [],
    "failed": [],
}
# fixed values: what a review action makes of a finding (review outcome, machine status)
REVIEW_OUTCOMES = {"confirm_candidate": ("consistent", "warning"), "record_observation": ("indeterminate", "manual"), "mark_source_unreadable": ("indeterminate", "manual"), "withdraw": (None, None)}
MISSING_RESULT = "<missing>"


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), c)


def worst(c: Column, ranks: dict[str, int]) -> Column:
    """Aggregate: the value of the highest rank."""
    return F.max_by(c, rank_of(c, ranks))


def compare_status(status: Column, result: Column, words: dict[str, str | None]) -> Column:
    """Blank results are mismatches, unknown status words manual; a slash stands for a long dash."""
    s, r = compact(status), compact(result)
    wanted = F.create_map(*[F.lit(x) for k, v in words.items() for x in (k, v or "")])
    want = F.try_element_at(wanted, s)
    ok = F.when(want == "", (r == CONFORMING) | is_actual_result(r)).when((want == "——") & (r == "/"), True).otherwise(r == want)
    return (
        F.when(want.isNull(), verdict("manual", "source_status_unresolved"))
        .when(r == "", verdict("mismatch", "report_result_missing"))
        .otherwise(verdict(F.when(ok, "match").otherwise("mismatch"), F.when(ok, "status_result_matched").otherwise("status_result_mismatch")))
    )


def conclusion_of_results(results: Column) -> Column:
    """Array of results to an item's conclusion: one nonconforming decides, placeholders only give '/'."""
    v = F.transform(results, compact)
    return (
        F.when(F.size(v) <= 0, MISSING_RESULT)
        .when(F.array_contains(v, NONCONFORMING), "不符合")
        .when(F.exists(v, lambda x: (x != "") & ~x.isin(*PLACEHOLDERS)), "符合")
        .otherwise("/")
    )


def conclusion_of_statuses(statuses: Column, words: dict[str, str | None]) -> Column:
    """Array of status words to a conclusion; null if one is unknown or there is none."""
    v = F.transform(statuses, compact)
    bad = next(k for k, w in words.items() if w == NONCONFORMING)
    good = next(k for k, w in words.items() if w is None)
    known = F.forall(v, lambda x: x.isin(*words))
    return F.when((F.size(v) > 0) & known, F.when(F.array_contains(v, bad), "不符合").when(F.array_contains(v, good), "符合").otherwise("/"))


def verdict_of(comparisons: Column, unresolved: Column | bool = False) -> Column:
    """Array of match, mismatch, manual to pass, error or manual."""
    return (
        F.when(F.array_contains(comparisons, "mismatch"), "error")
        .when((F.size(comparisons) <= 0) | F.exists(comparisons, lambda x: x != "match") | F.lit(unresolved), "manual")
        .otherwise("pass")
    )


def transition_ok(previous: Column, current: Column, machine: dict[str, list[str]], first: str) -> Column:
    """A legal step of a state machine; the first state must be ``first``."""
    legal = F.create_map(*[x for k, v in machine.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.when(previous.isNull(), current == first).otherwise(F.coalesce(F.array_contains(F.try_element_at(legal, previous), current), F.lit(False)))


def risk_class(decision: Column, reason: Column) -> Column:
    """A mismatch, B manual, C matched by a rule, D matched exactly, E excluded."""
    return F.when(decision == "mismatch", "A").when(decision == "manual", "B").when((decision == "matched") & (reason != "exact"), "C").when(decision == "matched", "D").otherwise("E")
