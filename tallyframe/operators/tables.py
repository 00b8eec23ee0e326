"""Printed tables against each other and against clauses, and the cascade that maps requirement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import channels, clauses, gates
from tallyframe.functions.channels import parameter_key, table_value
from tallyframe.functions.text import compact, is_actual_result, locator_text
from tallyframe.operators.lineage import kept
from tallyframe.operators.matching import mutually_unique


def following_rows(rows: DataFrame, keys: list[str], order: str, requirement: str) -> DataFrame:
    """Each row with the subclause heading that it stands under (null before the first one)."""
    heading = F.nullif(channels.leading_subclause(F.col(requirement)), F.lit(""))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(heading, ignorenulls=True).over(w))


def parent_results(rows: DataFrame, keys: list[str], order: str, requirement: str, result: str) -> DataFrame:
    """Each row with ``effective``: a placeholder under a marker takes the result of the rows that follow up to the next marker.

    One nonconforming row decides; else 'conforms' if any row says so; else the first measured value.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    opens = channels.leading_marker(F.col(requirement)) != ""
    part = F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = compact(F.col(result))
    numbered = rows.withColumn("__part", part).withColumn("__opens", opens)
    group = Window.partitionBy(*keys, "__part")
    real = r.isin("符合要求", "不符合要求") | is_actual_result(r)
    first = F.min(F.when(real, F.struct(F.col(order), F.col(result).alias("r")))).over(group)["r"]
    has = lambda v: F.max((r == v).cast("int")).over(group) == 1
    taken = F.when(has("不符合要求"), "不符合要求").when(has("符合要求"), "符合要求").otherwise(F.coalesce(first, F.col(result)))
    return numbered.withColumn("effective", F.when(F.col("__opens") & r.isin("——", "/"), taken).otherwise(F.col(result))).drop("__part", "__opens")


def label_bindings(references: DataFrame, tables: DataFrame) -> DataFrame:
    """(node, label, status, groups) of table labels in a clause: bound to one group of continued tables, ambiguous or unresolved.

    ``references`` has (node, label); ``tables`` has (node, table_group, caption).
    """
    t = tables.select("node", "table_group", compact(F.col("caption")).alias("seen"))
    r = references.withColumn("wanted", compact(F.col("label")))
    hit = (F.col("wanted") != "") & F.contains("seen", "wanted")
    out = r.join(t, "node", "left").groupBy("node", "label").agg(F.sort_array(F.collect_set(F.when(hit, F.col("table_group")))).alias("groups"))
    n = F.size("groups")
    return out.select("node", "label", F.when(n == 1, "bound").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"), "groups")


def ancestor_tables(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """(clause, holder, groups): the table groups of the nearest ancestor that has any.

    ``tables`` has (clause, table_group). An ancestor that occurs twice in ``nodes`` scopes
    nothing, nor does what lies above it.
    """
    held = tables.groupBy(F.col("clause").alias("holder")).agg(F.sort_array(F.collect_set("table_group")).alias("groups"))
    counts = nodes.groupBy(F.col("clause").alias("holder")).agg(F.count(F.lit(1)).alias("n"))
    ups = nodes.select("clause").distinct().select("clause", F.posexplode(clauses.ancestors(F.col("clause"))).alias("up", "holder"))
    known = ups.join(counts, "holder").join(held, "holder", "left")
    stop = (F.col("n") > 1) | F.col("groups").isNotNull()
    first = known.where(stop).groupBy("clause").agg(F.min_by(F.struct("holder", "groups", "n"), "up").alias("x"))
    return first.where("x.n = 1").select("clause", "x.holder", "x.groups")


def parameter_rows(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(clause, name, found, value): the table row of a clause that names a parameter.

    A row's key equals the parameter, or begins or ends with it; its value is null unless
    there is exactly one such key. ``asked`` has (clause, name); ``rows`` has (clause, key, value).
    """
    a = asked.withColumn("wanted", parameter_key(F.col("name")))
    r = rows.select("clause", parameter_key(F.col("key")).alias("have"), F.col("value").alias("cell"))
    hit = (F.col("wanted") != "") & (F.startswith("have", "wanted") | F.endswith("have", "wanted"))
    out = a.join(r, "clause", "left").groupBy("clause", "name").agg(F.count_distinct(F.when(hit, F.col("have"))).alias("found"), F.collect_set(F.when(hit, F.col("cell"))).alias("cells"))
    return out.select("clause", "name", "found", F.when((F.col("found") == 1) & (F.size("cells") == 1), F.try_element_at("cells", F.lit(1))).alias("value"))


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Rows of two tables by name, in both directions: (keys, name, left, right, verdict).

    A name that occurs with several values on one side is ambiguous; equal numbers that are
    written differently are a difference of writing.
    """

    def side(df: DataFrame, out: str) -> DataFrame:
        named = df.select(*keys, parameter_key(F.col(name)).alias("row_name"), table_value(F.col(value)).alias("v")).where("row_name <> ''")
        return named.groupBy(*keys, "row_name").agg(F.collect_set("v").alias(out))

    j = side(left, "l").join(side(right, "r"), [*keys, "row_name"], "full_outer")
    a, b = (F.try_element_at(c, F.lit(1)) for c in ("l", "r"))
    verdict = (
        F.when(F.col("r").isNull(), "left_only")
        .when(F.col("l").isNull(), "right_only")
        .when((F.size("l") > 1) | (F.size("r") > 1), "ambiguous")
        .when(a == b, "equal")
        .when(channels.same_number_written_differently(a, b), "written_differently")
        .otherwise("different")
    )
    return j.select(*keys, "row_name", F.array_join(F.sort_array("l"), "|").alias("left"), F.array_join(F.sort_array("r"), "|").alias("right"), verdict.alias("verdict"))


def continued_labels(tables: DataFrame, keys: list[str], order: str, label: str, continues: str) -> DataFrame:
    """Tables with the label of the table that they continue, over any number of pages."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(~F.col(continues), F.struct(F.col(label)))
    return tables.withColumn(label, F.when(F.col(continues), F.coalesce(F.col(label), F.last(start, ignorenulls=True).over(w)[label])).otherwise(F.col(label)))


def label_values(lines: DataFrame, keys: list[str], labels: list[str], text: str) -> DataFrame:
    """(keys, label, value): each line that holds a label, with what stands after the label and its colon."""
    names = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    found = lines.select(*keys, F.col(text).alias("__text"), names).where(F.contains("__text", "label"))
    after = F.expr("substring(__text, locate(label, __text) + length(label))")
    return found.select(*keys, "label", F.trim(F.regexp_replace(after, r"^\s*[:：]?", "")).alias("value"))


def map_requirements(source: DataFrame, target: DataFrame, group: str, least: int = 12) -> DataFrame:
    """Requirement rows of two sides within a group: (group, source_id, target_id, stage, reason).

    Stages in order, each on what the earlier ones left: equal locator texts; the same
    explicit clause with corresponding texts; containment of texts of ``least`` characters;
    compatible clauses. A stage takes only pairs that are unique on both sides. Then several
    target rows that the same source text holds are 1:n. Rows that remain are reported with a
    reason: candidates that exclude each other, or none. Both sides have (group, id, clause, text).
    """
    # one narrow row each: the texts are folded once
    s = source.select(group, F.col("id").alias("source_id"), channels.clause_token(F.col("clause")).alias("sc"), locator_text(F.col("text")).alias("st"))
    t = target.select(group, F.col("id").alias("target_id"), channels.clause_token(F.col("clause")).alias("tc"), locator_text(F.col("text")).alias("tt"))
    pairs = s.join(t, group)
    equal = (F.col("st") == F.col("tt")) & (F.col("st") != "")
    long = F.least(F.length("st"), F.length("tt")) >= least
    holds = long & F.contains("st", "tt")
    held = long & F.contains("tt", "st")
    same = (F.col("sc") == F.col("tc")) & (F.col("sc") != "")
    near = gates.clause_compatible(F.col("sc"), F.col("tc")) & (F.col("sc") != "")
    kinds = F.struct(equal.alias("equal_text"), (same & (holds | held)).alias("explicit_clause"), (holds | held).alias("containment"), near.alias("compatible_clause"), holds.alias("holds"))
    edges = pairs.select(group, "source_id", "target_id", kinds.alias("k")).where("k.equal_text or k.containment or k.compatible_clause")
    found: DataFrame | None = None
    left = edges = kept(edges)  # every stage reads what the earlier ones left
    for stage in ("equal_text", "explicit_clause", "containment", "compatible_clause"):
        step = mutually_unique(left.where(F.col(f"k.{stage}")).select(group, "source_id", "target_id"), "source_id", "target_id").withColumn("stage", F.lit(stage))
        step = kept(step)
        found = step if found is None else found.unionByName(step)
        for side in ("source_id", "target_id"):
            left = left.join(step.select(side), side, "left_anti")
        left = kept(left)
    only = left.where("k.holds").groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("target_id")
    several = left.where("k.holds").join(only, "target_id", "left_semi").select(group, "source_id", "target_id").withColumn("stage", F.lit("one_to_many"))
    found = kept(found.unionByName(several).withColumn("reason", F.lit("mapped")))
    out = found
    for side, other, rows in (("source_id", "target_id", s), ("target_id", "source_id", t)):
        rest = rows.select(group, side).join(found.select(side).distinct(), side, "left_anti")
        touched = edges.select(side).distinct().withColumn("touched", F.lit(True))
        reason = F.when(F.col("touched"), "candidates_not_unique").otherwise("no_candidate")
        out = out.unionByName(rest.join(touched, side, "left").select(group, side, F.lit(None).cast(dict(found.dtypes)[other]).alias(other), F.lit("left_over").alias("stage"), reason.alias("reason")))
    return out
