"""Ordered rows: fill-down, gaps, islands, occurrence keys, latest rows, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fill_down(df: DataFrame, group: list[str], order: list, columns: list[str], reset: Column | None = None) -> DataFrame:
    """Last non-null value so far; a row where ``reset`` holds starts anew."""
    base = Window.partitionBy(*group).orderBy(*order)
    if reset is not None:
        df = df.withColumn("__part", F.sum(F.when(reset, 1).otherwise(0)).over(base.rowsBetween(Window.unboundedPreceding, 0)))
        base = Window.partitionBy(*group, "__part").orderBy(*order)
    for c in columns:
        df = df.withColumn(c, F.last(c, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0)))
    return df.drop("__part")


def gaps(df: DataFrame, group: str, number: str) -> DataFrame:
    """Per group: numbers missing in 1..max, repeated ones, and whether 1 comes first."""
    per = df.groupBy(group, number).agg(F.count(F.lit(1)).alias("__n")).groupBy(group)
    out = per.agg(F.sort_array(F.collect_list(number)).alias("__have"), F.max(number).alias("last"), F.min(number).alias("first"), F.sort_array(F.collect_list(F.when(F.col("__n") > 1, F.col(number)))).alias("repeated"))
    return out.select(group, "first", "last", F.array_except(F.sequence(F.lit(1), F.col("last").cast("int")), F.col("__have").cast("array<int>")).alias("missing"), "repeated")


def islands(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """Maximal runs of consecutive distinct numbers: group, first, last, length."""
    one = df.select(*group, number).distinct()
    key = F.col(number) - F.row_number().over(Window.partitionBy(*group).orderBy(number))
    return one.withColumn("__island", key).groupBy(*group, "__island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("length")).drop("__island")


def range_text(df: DataFrame, group: str, number: str) -> DataFrame:
    """'1-3,5' for the numbers of each group."""
    runs = islands(df, [group], number)
    piece = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("first").alias("f"), piece.alias("p"))))
    return runs.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["p"]), ",").alias("ranges"))


def occurrence_keys(df: DataFrame, keys: list[str], order: list, out: str = "key") -> DataFrame:
    """'k' for a key that occurs once, 'k#n' for its nth occurrence otherwise."""
    text = F.concat_ws("-", *keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, F.when(n > 1, F.concat_ws("#", text, k)).otherwise(text))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, as one aggregation (no window, combined map-side)."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rest])


def row_lines(df: DataFrame, group: list[str], position: str, tolerance: float, out: str = "line") -> DataFrame:
    """Number of the line: a gap of over ``tolerance`` to the previous position starts a new one.

    Rows of one position share a line; rows without a position come last, each in a line of its own.
    """
    w = Window.partitionBy(*group).orderBy(F.asc_nulls_last(position))
    fresh = F.coalesce(F.col(position) - F.lag(position).over(w) > tolerance, F.lit(True))
    tied = w.orderBy(F.asc_nulls_last(position), F.desc("__new"))  # of equal positions the row that begins the line comes first
    return df.withColumn("__new", fresh.cast("int")).withColumn(out, F.sum("__new").over(tied.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def clusters_from_start(positions: Column, tolerance: float) -> Column:
    """Array of positions to the starts of clusters; each position is compared with its cluster's start."""
    far = lambda starts, x: F.coalesce(x - F.try_element_at(starts, F.lit(-1)) > tolerance, F.lit(True))
    return F.aggregate(F.array_sort(positions), F.array().cast("array<double>"), lambda s, x: F.when(far(s, x), F.array_append(s, x.cast("double"))).otherwise(s))


def next_value(df: DataFrame, group: list[str], order: list, is_key: Column, value: str, out: str) -> DataFrame:
    """For each key row, the value of the row that follows it."""
    return df.withColumn(out, F.when(is_key, F.lead(value).over(Window.partitionBy(*group).orderBy(*order))))


def spot_checks(df: DataFrame, group: str, key: str, quota: int, seed: str) -> DataFrame:
    """``quota`` rows per group by a seeded portable hash."""
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))
    return df.withColumn("__h", h).withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy("__h", key))).where(F.col("__k") <= quota).drop("__h", "__k")


def best_with_margin(df: DataFrame, group: str, score: str, candidate: str, ratio: float) -> DataFrame:
    """The best candidate per group and whether it beats the runner-up by ``ratio``."""
    w = Window.partitionBy(group).orderBy(F.desc(score), candidate)
    second = F.lead(score).over(w)
    clear = second.isNull() | (F.col(score) >= ratio * second)
    return df.withColumn("runner_up", second).withColumn("clear", clear).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def state_steps(events: DataFrame, key: str, order: list, state: str) -> DataFrame:
    """Each event with the state before it."""
    return events.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
