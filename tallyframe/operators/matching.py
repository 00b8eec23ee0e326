"""Matching of two sides. All of it starts from an equi key or a blocked theta join; ambiguity is never resolved by guessing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.operators.lineage import kept


def candidate_edges(source: DataFrame, target: DataFrame, on: Column, source_id: str, target_id: str) -> DataFrame:
    """Distinct (source_id, target_id) pairs that satisfy ``on``; give it an equality, or it is a nested loop."""
    return source.join(target, on).select(source_id, target_id).distinct()


def mutually_unique(edges: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """Edges whose ends both have exactly one edge.

    Degrees are aggregated before they are joined back, so a vertex with very many
    edges costs a partial count per task, not a window in one.
    """
    once = lambda k: edges.groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(k)
    return edges.join(once(source_id), source_id, "left_semi").join(once(target_id), target_id, "left_semi")


def longest_prefix(rows: DataFrame, key: str, dictionary: DataFrame, prefix: str, separator: str = ".") -> DataFrame:
    """Each row with the longest dictionary prefix of its dotted key (null if none).

    The key's own prefixes are exploded and joined by equality, so that no theta join
    is needed: the work grows with the depth of the keys.
    """
    parts = F.split(F.col(key), f"\\{separator}")
    tagged = rows.withColumn("__row", F.monotonically_increasing_id())
    ups = tagged.select("__row", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))).alias("__depth", prefix))
    best = ups.join(dictionary.select(prefix).distinct(), prefix).groupBy("__row").agg(F.max_by(prefix, "__depth").alias(prefix))
    return tagged.join(best, "__row", "left").drop("__row")


def tiered(source: DataFrame, target: DataFrame, source_id: str, target_id: str, tiers: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Cascade of equi matches: (source_id, target_id, tier), unique on both sides in its tier; later tiers see what is left.

    A tier is (name, key of the source, key of the target); null keys match nothing.
    """
    # one narrow row for each side's row, its keys hashed: no tier reads the sides again
    numbered = [f"k{i}" for i in range(len(tiers))]
    narrow = lambda df, i, side: kept(df.select(i, *[F.md5(tier[side].cast("string")).alias(k) for k, tier in zip(numbered, tiers, strict=True)]))
    left, right = narrow(source, source_id, 1), narrow(target, target_id, 2)
    found = None
    for k, (name, _, _) in zip(numbered, tiers, strict=True):
        if found is not None:
            left = left.join(found.select(source_id), source_id, "left_anti")
            right = right.join(found.select(target_id), target_id, "left_anti")
        one = lambda df, i, k=k: df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.first(i).alias(i)).where("n = 1").drop("n")
        step = kept(one(left, source_id).join(one(right, target_id), k).select(source_id, target_id, F.lit(name).alias("tier")))
        found = step if found is None else found.unionByName(step)
    return found


def reconcile(source: DataFrame, target: DataFrame, keys: list[str], judge: Callable[[], Column]) -> DataFrame:
    """Full outer join by key with a verdict: source_only, target_only, or what ``judge`` says; sides are 's' and 't'."""
    s = source.select(*keys, F.struct(*[c for c in source.columns if c not in keys]).alias("s"), F.lit(True).alias("__s"))
    t = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("t"), F.lit(True).alias("__t"))
    joined = s.join(t, keys, "full_outer")
    return joined.withColumn("disposition", F.when(F.col("__t").isNull(), "source_only").when(F.col("__s").isNull(), "target_only").otherwise(judge())).drop("__s", "__t")


def positional(source: DataFrame, target: DataFrame, group: str, source_order: list, target_order: list) -> DataFrame:
    """Row k of each group on one side against row k on the other."""
    number = lambda df, order, name: df.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*order))).select(group, "ordinal", F.struct(*df.columns).alias(name))
    return number(source, source_order, "s").join(number(target, target_order, "t"), [group, "ordinal"], "full_outer")


def as_of(events: DataFrame, versions: DataFrame, keys: list[str], event_time: str, version_time: str, value: str, strict: bool = False) -> DataFrame:
    """Each event with the value of the last version at (or before, if strict: before) its time.

    One union, one sort per key; no range join, so a key with n events and m versions
    costs n + m rows.
    """
    nulls = F.lit(None).cast(versions.schema[value].dataType)
    order = F.lit(1 if not strict else 0)
    e = events.select("*", F.col(event_time).alias("__t"), order.alias("__o"), nulls.alias("__v"), F.lit(True).alias("__event"))
    v = versions.select(*keys, F.col(version_time).alias("__t"), F.lit(1 - (0 if strict else 1)).alias("__o"), F.col(value).alias("__v"), F.lit(False).alias("__event"))
    both = e.unionByName(v, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"asof_{value}", F.last("__v", ignorenulls=True).over(w)).where("__event").drop("__t", "__o", "__v", "__event")


def band_join(rows: DataFrame, value: str, bands: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Rows with the bands [low, high) that hold their value, by equality on grid cells of ``width``."""
    cells = bands.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return rows.withColumn("__cell", F.floor(F.col(value) / width)).join(cells, "__cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")


def for_all(edges: DataFrame, key: str, holds: Column) -> DataFrame:
    """Keys for which the condition holds on every row (and at least one)."""
    return edges.groupBy(key).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("ok")).where("ok").select(key)


def by_candidates(count: Column, equal: Column) -> Column:
    """Verdict of a lookup: none is missing, several are manual even if one is equal."""
    return F.when(F.coalesce(count, F.lit(0)) == 0, "missing").when(count > 1, "manual").when(equal, "matched").otherwise("mismatch")


def expand_references(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, referred) from 'see item N' and 'see items N to M' in a text, ranges expanded.

    A range that runs backwards or over more than 2000 items isn't followed: its row has
    referred null, which is for a person to decide.
    """
    ranges = F.regexp_extract_all(F.col(text), F.lit(r"见?(?:第|序号|item )\s*([0-9]+)\s*(?:[~～至-]\s*([0-9]+))?"), F.lit(0))
    spans = items.select(item, F.explode(ranges).alias("__r"))
    first = F.regexp_extract("__r", "([0-9]+)", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract("__r", r"[~～至-]\s*([0-9]+)", 1).try_cast("int"), first)
    followed = F.coalesce((last >= first) & (last - first <= 2000), F.lit(False))
    none = F.array(F.lit(None).cast("int"))
    return spans.select(item, F.explode(F.when(followed, F.sequence(first, F.greatest(first, last))).otherwise(none)).alias("referred")).distinct()


def contained(needles: DataFrame, needle_id: str, needle: str, rows: DataFrame, row_id: str, text: str, anchor: int = 12) -> DataFrame:
    """(needle_id, row_id) where the needle occurs in the text, from needles of at least one word.

    Rows are blocked by word: a needle is sent to the rows that hold its longest full
    word, and only those are searched. Needles without an inner word are tried by
    their first ``anchor`` characters on all rows.
    """
    inner = F.filter(F.slice(F.split(needle, " "), F.lit(2), F.greatest(F.size(F.split(needle, " ")) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = needles.select(F.col(needle_id), F.col(needle).alias("__needle"), longest.alias("__word"))
    wanted = keyed.select("__word").where("__word is not null").distinct()
    words = rows.select(F.col(row_id), F.col(text).alias("__text"), F.explode(F.array_distinct(F.split(text, " "))).alias("__word"))
    hits = words.join(wanted, "__word", "left_semi").join(keyed, "__word").where(F.contains("__text", "__needle")).select(needle_id, row_id)
    short = keyed.where("__word is null and __needle <> ''")
    more = rows.select(F.col(row_id), F.col(text).alias("__text")).join(short, F.contains("__text", F.substring("__needle", 1, anchor)) & F.contains("__text", "__needle")).select(needle_id, row_id)
    return hits.unionByName(more).distinct()


def page_hits(points: DataFrame, boxes: DataFrame, page: str, stroke: str, box_id: str, slack: float = 1.5, margin: float = 0.75) -> DataFrame:
    """Strokes to the box that holds most of their points; ambiguous if the runner-up has ``margin`` of the winner's.

    ``points`` has (page, stroke, x, y); ``boxes`` has (page, box_id, x0, y0, x1, y1).
    """
    near = points.join(boxes, page).where(F.col("x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("y").between(F.col("y0") - slack, F.col("y1") + slack))
    off = F.hypot(F.col("x") - (F.col("x0") + F.col("x1")) / 2, F.col("y") - (F.col("y0") + F.col("y1")) / 2)
    counts = near.groupBy(page, stroke, box_id).agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("d"))
    w = Window.partitionBy(page, stroke).orderBy(F.desc("n"), "d", box_id)
    ranked = counts.withColumn("__k", F.row_number().over(w)).withColumn("__next", F.lead("n").over(w))
    return ranked.where("__k = 1").withColumn("ambiguous", F.coalesce(F.col("__next") >= margin * F.col("n"), F.lit(False))).drop("__k", "__next", "d")
