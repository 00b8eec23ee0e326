"""A fixed-size bit table of ids, to keep rows that no join wants out of its shuffle.

Each id sets one of 2**25 bits. The table has at most 2**19 rows of 64 bits (8 MB),
whatever the number of ids, which bounds its broadcast. It lets through every id of
the set and, the fuller it is, others as well; the exact join always follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 19


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (Spark's names ignore case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def _place(c: Column) -> tuple[Column, Column]:
    h = F.xxhash64(c)
    return F.pmod(h, F.lit(WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))


def bit_table(ids: DataFrame, column: str) -> DataFrame:
    word, bit = _place(F.col(column))
    return ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def with_possible(rows: DataFrame, column: str, bits: DataFrame, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: false where the id is certainly not in the set."""
    place, word, held = (fresh([*rows.columns, flag], f"__{x}") for x in ("place", "word", "bits"))
    where, bit = _place(F.col(column))
    table = F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(held)))
    joined = rows.withColumn(place, where).join(table, F.col(place) == F.col(word), "left")
    return joined.select(*rows.columns, F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False)).alias(flag))
