"""Dates by format; a text that isn't a valid date is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import compact

# fixed values: format label -> (shape, pattern for try_to_date)
FORMATS = {
    "YYYY-MM-DD": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    "YYYY.MM.DD": (r"^[0-9]{4}\.[0-9]{2}\.[0-9]{2}$", "yyyy.MM.dd"),
    "YYYY/MM/DD": (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
    "YYYYMMDD": (r"^[0-9]{8}$", "yyyyMMdd"),
    "YYYY年MM月DD日": (r"^[0-9]{4}年[0-9]{2}月[0-9]{2}日$", "yyyy年MM月dd日"),
}


def parse_any(c: Column) -> Column:
    """The date in any of the five formats."""
    t = compact(c)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_date(t, pattern)) for shape, pattern in FORMATS.values()])


def format_label(c: Column) -> Column:
    """Which of the five formats a valid date is written in."""
    t = compact(c)
    return F.coalesce(*[F.when(t.rlike(shape) & F.try_to_date(t, pattern).isNotNull(), label) for label, (shape, pattern) in FORMATS.items()])


def strict_chinese(c: Column) -> Column:
    """YYYY年M月D日 without padding or white space."""
    shape = r"^([0-9]{4})年([1-9][0-9]?)月([1-9][0-9]?)日$"
    padded = F.concat(F.regexp_extract(c, shape, 1), F.lit("-"), F.lpad(F.regexp_extract(c, shape, 2), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(c, shape, 3), 2, "0"))
    return F.when(c.rlike(shape), F.try_to_date(padded, "yyyy-MM-dd"))


def compare_dates(value: Column, reading: Column) -> Column:
    """match, format (same day, written differently), mismatch, or manual if one isn't a date."""
    a, b = parse_any(value), parse_any(reading)
    return F.when(a.isNull() | b.isNull(), "manual").when(a != b, "mismatch").when(format_label(value) == format_label(reading), "match").otherwise("format")


def order_issue(*dates: Column) -> Column:
    """1-based place of the first date that lies before its predecessor; 0 if none does."""
    out = F.lit(0)
    for i in range(len(dates) - 1, 0, -1):
        out = F.when(dates[i] < dates[i - 1], i + 1).otherwise(out)
    return out
