"""References between items, clause numbers that moved, and rows that a declared scope leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import clauses
from tallyframe.functions.status import conclusion_of_results
from tallyframe.functions.text import compact

#: A range of items over this length is not followed; the item that holds it stays undecided.
LONGEST_RANGE = 500
_SINGLE, _RANGE = r"^见序号([0-9]+)(?:中([0-9]+(?:\.[0-9]+)*))?$", r"^见序号([0-9]+)～序号([0-9]+)$"


def referred_conclusions(items: DataFrame, item: str = "item", requirement: str = "requirement", result: str = "result", conclusion: str = "conclusion") -> DataFrame:
    """(item, derived) for items whose results only point to others; derived is null where a reference can't be followed.

    'See item N' takes N's conclusion (its first written one, else that of its results),
    'see item N under C' that of N's rows whose requirement begins with C, and 'see items N
    to M' all of theirs. ``items`` has one row for each requirement; rows keep no order, so
    the smallest written conclusion stands for the first.
    """
    rows = items.select(F.col(item).cast("long").alias("item"), compact(F.col(requirement)).alias("requirement"), compact(F.col(result)).alias("result"), compact(F.col(conclusion)).alias("conclusion"))
    single = F.regexp_extract("result", _SINGLE, 1)
    first = F.nullif(F.concat(single, F.regexp_extract("result", _RANGE, 1)), F.lit("")).try_cast("long")
    last = F.coalesce(F.nullif(F.regexp_extract("result", _RANGE, 2), F.lit("")).try_cast("long"), first)
    points = rows.where("result <> ''").select("item", first.alias("first"), last.alias("last"), F.regexp_extract("result", _SINGLE, 2).alias("under"))
    only = points.groupBy("item").agg(F.bool_and(F.col("first").isNotNull()).alias("all_point")).where("all_point").select("item")
    followed = (F.col("last") >= F.col("first")) & (F.col("last") - F.col("first") <= LONGEST_RANGE)
    span = F.when(followed, F.sequence("first", F.greatest("first", "last"))).otherwise(F.array(F.lit(None).cast("long")))
    asked = points.join(only, "item", "left_semi").select("item", "under", F.explode(span).alias("referred"))
    whole = rows.groupBy(F.col("item").alias("referred")).agg(F.min(F.nullif("conclusion", F.lit(""))).alias("written"), conclusion_of_results(F.collect_set("result")).alias("expected"))
    whole = whole.select("referred", F.coalesce("written", "expected").alias("found"))
    plain = asked.where("under = ''").join(whole, "referred", "left").select("item", "found")
    parts = asked.where("under <> ''").distinct().alias("a").join(rows.alias("r"), F.col("a.referred") == F.col("r.item"), "left")
    begins = F.col("requirement").startswith(F.col("under")) & ~F.substring("requirement", F.length("under") + 1, F.lit(1)).rlike("[0-9.]")
    parts = parts.groupBy("a.item", "a.under", "a.referred").agg(F.collect_set(F.when(begins, F.col("r.result"))).alias("results"))
    parts = parts.select("item", F.when(F.size("results") > 0, conclusion_of_results(F.col("results"))).alias("found"))
    known = plain.unionByName(parts).groupBy("item").agg(F.bool_and(F.col("found").isNotNull()).alias("all_known"), F.max((F.col("found") == "不符合").cast("int")).alias("bad"), F.max((F.col("found") == "符合").cast("int")).alias("good"))
    return known.select("item", F.when(F.col("all_known"), F.when(F.col("bad") == 1, "不符合").when(F.col("good") == 1, "符合").otherwise("/")).alias("derived"))


def moved_clauses(declared: DataFrame, printed: DataFrame, clause: str = "clause", title: str = "title", keys: list[str] | None = None, least: int = 2) -> DataFrame:
    """Printed clauses whose title belongs to another sibling of the declared ones: (keys, clause, declared_clause).

    Titles of under ``least`` characters tell nothing; a title that several siblings have is
    taken for the last of them, and clauses that still hold their own title didn't move.
    """
    keys = keys or []
    d = declared.select(*keys, F.col(clause).alias("declared_clause"), clauses.parent(F.col(clause)).alias("up"), compact(F.col(title)).alias("t")).where(F.length("t") >= least)
    d = d.groupBy(*keys, "up", "t").agg(F.max_by("declared_clause", clauses.path(F.col("declared_clause"))).alias("declared_clause"))
    own = declared.select(*keys, F.col(clause).alias("clause"), compact(F.col(title)).alias("own"))
    p = printed.select(*keys, F.col(clause).alias("clause"), clauses.parent(F.col(clause)).alias("up"), compact(F.col(title)).alias("t")).where("t <> ''")
    p = p.join(own, [*keys, "clause"]).where(~(F.col("own").startswith(F.col("t")) | F.col("t").startswith(F.col("own"))) | (F.col("own") == ""))
    return p.join(d, [*keys, "up", "t"]).where("clause <> declared_clause").select(*keys, "clause", "declared_clause")


def shift_runs(moved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs of consecutive clauses that moved by the same number: (keys, up, offset, first, last, length)."""
    keys = keys or []
    number = lambda c: F.regexp_extract(c, r"\.([0-9]+)$", 1).try_cast("int")
    rows = moved.select(*keys, clauses.parent(F.col("clause")).alias("up"), number("clause").alias("n"), (number("declared_clause") - number("clause")).alias("offset"))
    island = F.col("n") - F.row_number().over(Window.partitionBy(*keys, "up", "offset").orderBy("n"))
    return rows.distinct().withColumn("island", island).groupBy(*keys, "up", "offset", "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("length")).drop("island")


def scope_holes(declared: DataFrame, covered: DataFrame, clause: str = "clause", keys: list[str] | None = None) -> DataFrame:
    """Declared clauses that neither stand in ``covered`` themselves nor have a clause below them there."""
    keys = keys or []
    have = covered.select(*keys, clauses.canonical(F.col(clause)).alias("c"))
    ups = have.select(*keys, F.explode(F.array_union(F.array("c"), clauses.ancestors(F.col("c")))).alias("c")).distinct()
    return declared.withColumn("c", clauses.canonical(F.col(clause))).join(ups, [*keys, "c"], "left_anti").drop("c")


def conclusion_cells(cells: DataFrame, item: str, page: str, text: str) -> DataFrame:
    """(item, page, filled, blank) where a merged conclusion cell covers only part of an item's rows."""
    filled = F.sum((compact(F.col(text)) != "").cast("long"))
    out = cells.groupBy(item, page).agg(filled.alias("filled"), (F.count(F.lit(1)) - filled).alias("blank"))
    return out.where("filled > 0 and blank > 0")


def sequence_conclusion(statuses: Column, reasons: Column, wanted: Column, observed: Column, missing: Column) -> Column:
    """struct(decision, reason) for an item: its source statuses (an array) against what its results say.

    A blank box is a mismatch at once; an unread status leaves the item to a person unless
    another row doesn't conform. ``wanted`` is the conclusion of the statuses.
    """
    blank = F.array_contains(reasons, "status_box_blank")
    near = F.array_contains(reasons, "status_mark_near_checkbox_unresolved")
    known = F.coalesce(F.array_contains(statuses, "不符合"), F.lit(False)) | ~F.exists(statuses, lambda s: s.isNull())
    decision = F.when(blank, "mismatch").when(~known | missing, "manual").when(observed == wanted, "match").otherwise("mismatch")
    reason = (
        F.when(blank, "record_status_blank")
        .when(~known, F.when(near, "record_status_near_checkbox_unresolved").otherwise("record_sequence_status_unresolved"))
        .when(missing, "report_sequence_result_missing")
        .when(observed == wanted, "sequence_result_matched")
        .otherwise("sequence_result_mismatch")
    )
    return F.struct(decision.alias("decision"), reason.alias("reason"))
