"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal keys, here equal texts) must not be cut. They are
sorted by total size and each enters the bin with the tightest remaining
capacity that still holds it, found in a balanced tree of remaining capacities.

To do this for any number of groups, the sort key is a *size class*: sizes up
to 2**12 are exact, larger ones are rounded up to 12 significant bits. Groups
of one class are interchangeable, so the packer sees (class, count) and places
whole runs: best fit puts equal items into the same bin until it is full, hence
one tree operation places ``min(count, room // class)`` of them. The driver
holds at most 2**12 + 52 * 2**11 classes, whatever the input. Rows find their
shard by the rank of their group in its class; ranks come from counts per
(class, salt) and a row number within, so no task sees a whole hot class.

Only a group that is larger than a shard (the capacity, or the mean of all shards)
is cut, into as few parts as hold it; its rows are dealt to the parts by their rank,
so that no part is over the bound unless a single row is. Groups over
``1 / split_above`` of a shard may have many rows: their shards are broadcast to the
rows instead of joined by a shuffle; there are at most ``shards * split_above``.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.llm.store import cut

EXACT_BITS = 12


def size_class(size: Column) -> Column:
    """Round up to ``EXACT_BITS`` significant bits (exact below 2**EXACT_BITS)."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - EXACT_BITS)
    return size + F.pmod(-size, F.call_function("shiftleft", F.lit(1).cast("long"), drop))


class Bins:
    """Open bins in a balanced order of (remaining capacity, number)."""

    def __init__(self, capacity: int, limit: int | None = None):
        self.capacity, self.limit, self.free, self.opened = capacity, limit, [], 0
        if limit is not None:
            self.free = [(capacity, b) for b in range(limit)]
            self.opened = limit

    def place(self, size: int, count: int) -> list[tuple[int, int]] | None:
        """(bin, how many) for ``count`` items of one size; None if they don't fit."""
        out = []
        while count:
            at = bisect_left(self.free, (size, -1))
            if at == len(self.free):
                if self.limit is not None:
                    return None
                insort(self.free, (max(self.capacity, size), self.opened))
                self.opened += 1
                continue
            room, number = self.free.pop(at)
            n = min(count, room // size)
            out.append((number, n))
            insort(self.free, (room - n * size, number))
            count -= n
        return out


def pack(histogram: list[tuple[int, int]], capacity: int, limit: int | None = None):
    """Best-fit-decreasing over (size, count) runs: rows (size, first rank, end rank, bin), or None."""
    bins, rows = Bins(capacity, limit), []
    for size, count in sorted(histogram, reverse=True):
        placed = bins.place(size, count)
        if placed is None:
            return None
        first = 0
        for number, n in placed:
            rows.append((size, first, first + n, number))
            first += n
    return rows


def pack_into(histogram: list[tuple[int, int]], shards: int):
    """Smallest capacity (within 1e-4 of the mean) at which best fit fills ``shards`` bins."""
    if not histogram:
        return []
    total = sum(s * n for s, n in histogram)
    low = max(-(-total // shards), max(s for s, _ in histogram))
    step, high = max(1, low // 10_000), low
    width = step
    while (rows := pack(histogram, high, shards)) is None:
        low, high, width = high + 1, high + width, width * 2
    while high - low > step:
        middle = (low + high) // 2
        found = pack(histogram, middle, shards)
        if found is None:
            low = middle + 1
        else:
            high, rows = middle, found
    return rows


def ranked(df: DataFrame, keys: list[str], order: list[str], salt: Column, out: str) -> DataFrame:
    """Gapless rank from 0 within ``keys``; counts per (keys, salt) give each part its start."""
    df = df.withColumn("__salt", salt)
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    counts = df.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        df.withColumn("__row", F.row_number().over(part))
        .join(starts, [*keys, "__salt"])
        .withColumn(out, (F.col("__start") + F.col("__row") - 1).cast("long"))
        .drop("__salt", "__n", "__row", "__start")
    )


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    *,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 256,
    split_above: int = 8,
) -> DataFrame:
    """Assign every row a shard and a slot; groups are rows with equal text.

    With ``capacity`` the number of shards is what best fit needs; else there
    are ``shards`` bins of the smallest capacity that holds everything.

    Columns: id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (null text:
    that of no bytes), shard, slot (gapless from 0 in each shard). Null ids are
    rows like others and come first in slot order; repeated rows are
    kept and ranked one after another; other columns of the input are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__a"),
        F.md5(text).substr(1, 16).alias("__b"),
    )
    rows = cut(rows)
    group = ["size", "__a", "__b"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = capacity or max(1, total // shards)
    # at most total / (mean / split_above) groups are over the bound
    large = groups.where(F.col("size") * F.col("__rows") * split_above > mean).where(F.col("__rows") > 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(mean) / F.col("size")))  # rows of the group that one shard holds
    large = large.select(*group, F.ceil(F.col("__rows") / each).alias("__parts"))
    rows = rows.join(F.broadcast(large), group, "left").withColumn("__large", F.col("__parts").isNotNull())
    beyond = F.coalesce(F.col("__parts") > 1, F.lit(False))
    dealt = ranked(rows.where(beyond), group, ["doc_id"], F.pmod(F.xxhash64("doc_id"), F.lit(salts)), "__at")
    dealt = dealt.withColumn("__part", F.pmod("__at", "__parts")).drop("__at")
    rows = rows.where(~beyond).withColumn("__part", F.lit(0).cast("long")).unionByName(dealt).drop("__parts")
    rows = cut(rows)
    group = [*group, "__part", "__large"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows")).withColumn("__w", F.col("size") * F.col("__rows"))
    groups = groups.withColumn("__class", size_class(F.col("__w")))
    groups = cut(groups)
    histogram = [(r[0], r[1]) for r in groups.groupBy("__class").count().collect()]
    placed = pack(histogram, capacity) if capacity else pack_into(histogram, shards)
    runs = spark.createDataFrame(placed, T.StructType([T.StructField(n, T.LongType(), False) for n in ("__class", "__first", "__end", "__bin")]))
    groups = ranked(groups, ["__class"], group, F.pmod(F.col("__a"), F.lit(salts)), "__rank")
    # a class has at most as many runs as there are bins; the table is bounded by classes + bins
    groups = groups.join(F.broadcast(runs), "__class").where((F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")))
    groups = cut(groups.select(*group, F.col("__bin").cast("int").alias("shard")))
    out = rows.where(~F.col("__large")).join(groups.where(~F.col("__large")), group)
    out = out.unionByName(rows.where("__large").join(F.broadcast(groups.where("__large")), group))
    out = out.select("doc_id", "size", "text_crc32", "shard")
    return ranked(out, ["shard"], ["doc_id", "size", "text_crc32"], F.pmod(F.xxhash64("doc_id"), F.lit(salts)), "slot")
