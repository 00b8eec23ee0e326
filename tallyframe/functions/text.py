"""Text normalisers as Column expressions; raw text stays in its own column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: marks that stand for "no result", and single dashes that don't
PLACEHOLDERS = ("——", "/")
SINGLE_DASHES = ("-", "–", "—", "−")
CONFORMING, NONCONFORMING = "符合要求", "不符合要求"


def compact(c: Column) -> Column:
    """No white space at all; null becomes ''."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", "")


def display_text(c: Column) -> Column:
    """Runs of white space become one space; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


def fold_units(c: Column) -> Column:
    """One code point for micro, ohm and degree signs."""
    return F.replace(F.translate(c, "µΩ", "μΩ"), F.lit("℃"), F.lit("°C"))


def fold_punctuation(c: Column) -> Column:
    """Full-width punctuation to ASCII."""
    return F.translate(c, "，。；：（）【】「」“”‘’！？、～－−–—", ",.;:()[][]\"\"''!?,~----")


def comparison_text(c: Column) -> Column:
    """Form in which two wordings are compared: NFKC, folded, without white space or final marks."""
    return F.regexp_replace(compact(fold_punctuation(fold_units(nfkc(c)))), r"[.,;:]+$", "")


def locator_text(c: Column) -> Column:
    """Key for finding the same row: l and I before digits read as 1; letters, digits, Han and unit signs only; lower case."""
    ones = F.regexp_replace(fold_units(nfkc(c)), r"(?<![A-Za-z])[lI](?=[0-9.])", "1")
    return F.lower(F.regexp_replace(ones, r"[^0-9A-Za-z\p{IsHan}μΩ%°]", ""))


def strip_punctuation(c: Column) -> Column:
    """Without punctuation, but for points between digits."""
    return F.regexp_replace(c, r"(?<![0-9])\.|\.(?![0-9])|[,;:!?()\[\]\"'、，。；：（）]", "")


def fold_brackets(c: Column) -> Column:
    return F.translate(c, "（）［］", "()[]")


def has_mixed_brackets(c: Column) -> Column:
    """Both full-width and ASCII round brackets."""
    return c.rlike("[（）]") & c.rlike("[()]")


def name_relation(a: Column, b: Column) -> Column:
    """same, bracket_width (equal once widths are folded) or different."""
    a, b = compact(a), compact(b)
    return F.when(a == b, "same").when(fold_brackets(a) == fold_brackets(b), "bracket_width").otherwise("different")


def is_actual_result(c: Column) -> Column:
    """A measured value: not blank, no placeholder, no verdict word, and with a letter or digit."""
    v = compact(c)
    return ~v.isin("", *PLACEHOLDERS, *SINGLE_DASHES, CONFORMING, NONCONFORMING) & v.rlike("[0-9A-Za-z]")


def semantic_signature(c: Column) -> Column:
    """Numbers, units, comparators and negations in the order of the text."""
    t = fold_units(c)
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    return F.struct(
        every(r"[0-9]+(?:\.[0-9]+)?").alias("numbers"),
        every(r"(?<=[0-9])\s*(?:[kMmμunp]?(?:A|V|W|Hz|Ω|F|s|Pa|g|m)|%|°C|dB)(?![A-Za-z])").alias("units"),
        every(r"[<>≤≥＜＞]|不大于|不小于|不超过|至少").alias("comparators"),
        every(r"不|无|未|非").alias("negations"),
    )


def standards_in(c: Column) -> Column:
    """Standard numbers such as GB 9706.1-2020, sorted, without white space."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?:GB|YY|ISO|IEC|EN)(?:/T)?\s*[0-9]+(?:\.[0-9]+)*(?:\s*[-—–]\s*[0-9]{4})?"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))))


def tables_in(c: Column) -> Column:
    """Numbers of the tables that a text refers to."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"表\s*([0-9]+(?:\.[0-9]+)*)"), F.lit(1))))


def unit_context(c: Column) -> Column:
    """X of a note 'unit: X'; null without one."""
    return F.nullif(F.regexp_extract(c, r"单位\s*[:：]\s*([^\s,，;；)）]+)", 1), F.lit(""))


def unit_labels(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"单位\s*[:：]\s*([^\s,，;；)）]+)"), F.lit(1))))


def condition_tokens(c: Column, labels: dict[str, str]) -> Column:
    """Labels whose pattern occurs, in the order given."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(label)) for label, p in labels.items()]))


def header_positions(header: Column, required: list[str]) -> Column:
    """Map from each required title to its place (from 0) in a header row; -1 where it is missing."""
    titles = F.transform(header, compact)
    return F.map_from_arrays(F.array(*[F.lit(r) for r in required]), F.array(*[F.array_position(titles, r).cast("int") - 1 for r in required]))


def is_result_table(header: Column, required: list[str]) -> Column:
    titles = F.transform(header, compact)
    return F.forall(F.array(*[F.lit(r) for r in required]), lambda r: F.array_contains(titles, r))


def stable_finding_key(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1))


def is_page_counter(c: Column) -> Column:
    """A line that only numbers the page."""
    return compact(c).rlike(r"^(?:第[0-9]+页)?(?:[,，]?共[0-9]+页)?$|^-?[0-9]+-?$|^[0-9]+/[0-9]+$") & (compact(c) != "")


def split_auxiliary_lines(c: Column, pattern: str = r"^\s*(?:注|备注|单位)\s*[0-9]*\s*[:：]") -> Column:
    """Lines of a requirement apart from labelled notes: struct(main, notes)."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    return F.struct(
        F.array_join(F.filter(lines, lambda x: ~x.rlike(pattern)), "\n").alias("main"),
        F.filter(lines, lambda x: x.rlike(pattern)).alias("notes"),
    )
