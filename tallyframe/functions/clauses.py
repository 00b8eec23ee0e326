"""Dotted clause ids: paths, order, descent, ranges and scopes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = r"[0-9]+(?:\.[0-9]+)*(?:\s*[a-z]\)?)?"
RANGE_LIMIT, LETTER_LIMIT = 500, 26


def canonical(c: Column) -> Column:
    """'2.4.1 a)' as '2.4.1a': ASCII points, no white space, brackets or final points, lower-case letter."""
    t = F.regexp_replace(F.translate(c, "．。（）", "..()"), r"[\s()]", "")
    return F.lower(F.regexp_replace(t, r"\.+$", ""))


def path(c: Column) -> Column:
    """The numbers of a clause id, for natural order: 2.10 after 2.9."""
    return F.transform(F.regexp_extract_all(canonical(c), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def letter(c: Column) -> Column:
    return F.regexp_extract(canonical(c), "([a-z])$", 1)


def parent(c: Column) -> Column:
    """The clause without its letter or its last number; null for a top clause."""
    t = canonical(c)
    return F.when(t.rlike("[a-z]$"), F.regexp_replace(t, "[a-z]$", "")).when(F.instr(t, ".") > 0, F.regexp_replace(t, r"\.[0-9]+$", ""))


def ancestors(c: Column) -> Column:
    """All proper prefixes, nearest first."""
    p = path(c)
    numbers = F.when(letter(c) != "", F.size(p)).otherwise(F.size(p) - 1)
    up = F.sequence(numbers, F.lit(1), F.lit(-1))
    return F.when(numbers > 0, F.transform(up, lambda n: F.array_join(F.slice(p.cast("array<string>"), F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))


def is_within(clause: Column, scope: Column) -> Column:
    """The clause is the scope or lies below it: equal, a further number, or a letter."""
    c, s = canonical(clause), canonical(scope)
    return (c == s) | c.startswith(F.concat(s, F.lit("."))) | (c.startswith(s) & F.substring(c, F.length(s) + 1, F.length(c)).rlike("^[a-z]$") & ~s.rlike("[a-z]$"))


def in_range(clause: Column, first: Column, last: Column) -> Column:
    """The clause or an ancestor of the ends' depth lies between two siblings."""
    p, a, b = path(clause), path(first), path(last)
    n = F.size(a)
    stem = lambda x: F.slice(x, F.lit(1), n - 1)
    return (F.size(b) == n) & (F.size(p) >= n) & (stem(a) == stem(b)) & (stem(p) == stem(a)) & F.try_element_at(p, n).between(F.try_element_at(a, n), F.try_element_at(b, n))


def is_next(previous: Column, current: Column) -> Column:
    """Siblings of which the second has the following number."""
    a, b = path(previous), path(current)
    n = F.size(a)
    return (F.size(b) == n) & (F.slice(a, F.lit(1), n - 1) == F.slice(b, F.lit(1), n - 1)) & (F.try_element_at(b, n) == F.try_element_at(a, n) + 1)


def expand_range(first: Column, last: Column) -> Column:
    """All sibling clauses from first to last, numbers or letters; null if that isn't a range."""
    a, b, x = path(first), path(last), letter(first)
    n = F.size(a)
    y = F.when(F.size(b) == 0, canonical(last)).otherwise(letter(last))
    stem = F.array_join(a.cast("array<string>"), ".")
    letters = F.transform(F.sequence(F.ascii(x), F.greatest(F.ascii(x), F.ascii(y))), lambda i: F.concat(stem, F.char(i)))
    lettered = F.when((y.rlike("^[a-z]$")) & ((F.size(b) == 0) | (a == b)) & F.ascii(y).between(F.ascii(x), F.ascii(x) + LETTER_LIMIT), letters)
    low, high = F.try_element_at(a, n), F.try_element_at(b, n)
    head = F.array_join(F.slice(a.cast("array<string>"), F.lit(1), F.greatest(n - 1, F.lit(0))), ".")
    numbers = F.transform(F.sequence(low, F.greatest(low, high)), lambda i: F.concat_ws(".", F.nullif(head, F.lit("")), i.cast("string")))
    siblings = (F.size(b) == n) & (F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(b, F.lit(1), F.greatest(n - 1, F.lit(0)))) & high.between(low, low + RANGE_LIMIT)
    return F.when(x != "", lettered).when((y == "") & siblings, numbers)


SCOPE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("included", T.ArrayType(T.StringType())),
        T.StructField("excluded", T.ArrayType(T.StringType())),
        T.StructField("only", T.ArrayType(T.StringType())),
        T.StructField("unresolved", T.ArrayType(T.StringType())),
    ]
)
_TOKEN = re.compile(r"^(?P<n>\d+(?:\.\d+)*)?(?P<l>[a-z])?$")


def split_top_level(text: str, marks: str = "、,，;；") -> list[str]:
    """Parts between marks that stand outside of brackets."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "(（[【":
            depth += 1
        elif ch in ")）]】":
            depth = max(0, depth - 1)
        elif ch in marks and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def _clauses(piece: str, stem: str) -> tuple[list[str] | None, str]:
    """Clause ids of '2.1', '2.1～2.3', '2.4.1a～c' or, after such, 'd'; and the stem for what follows."""
    ends = [re.sub(r"[\s()（）]", "", x).rstrip(".").lower() for x in re.split(r"[~～〜∼至-]", piece)]
    found = [_TOKEN.match(x) if x else None for x in ends]
    if len(ends) > 2 or not all(found):
        return None, stem
    number, low = found[0]["n"] or (stem if found[0]["l"] else ""), found[0]["l"]
    if not number:
        return None, stem
    if len(ends) == 1:
        return [number + (low or "")], number if low else stem
    to, high = found[1]["n"] or (number if found[1]["l"] else ""), found[1]["l"]
    if low or high:
        span = range(ord(low or "b"), ord(high or "a") + 1)
        return ([number + chr(i) for i in span], number) if low and high and to == number and 0 < len(span) <= LETTER_LIMIT + 1 else (None, stem)
    a, b = number.split("."), to.split(".")
    span = range(int(a[-1]), int(b[-1]) + 1)
    if a[:-1] != b[:-1] or not 0 < len(span) <= RANGE_LIMIT + 1:
        return None, stem
    return [".".join([*a[:-1], str(i)]) for i in span], stem


def scope_of(text: str | None) -> dict:
    """Included, excluded and only-clauses of a scope expression; anything unread makes it manual."""
    out: dict = {"status": "manual", "included": [], "excluded": [], "only": [], "unresolved": []}

    def take(part: str, into: str) -> None:
        stem = ""
        for piece in split_top_level(part):
            ids, stem = _clauses(piece, stem)
            if ids is None:
                out["unresolved"].append(piece)
            else:
                out[into] += [i for i in ids if i not in out[into]]

    body = re.sub(r"\s+", "", text or "")
    body = re.sub(r"(?<=[a-z])[)）]", "", body)
    for note in re.findall(r"[(（]([^()（）]*)[)）]", body):
        if note.startswith("除"):
            ids = re.findall(r"\d+(?:\.\d+)+[a-z]?(?:[~～至-]\d+(?:\.\d+)+[a-z]?)?", note)
            take("、".join(ids), "excluded") if ids else out["excluded"].append(note[1:])
        elif note.startswith("仅检"):
            ids = re.findall(r"\d+(?:\.\d+)+[a-z]?(?:[~～至-]\d+(?:\.\d+)+[a-z]?)?", note)
            take("、".join(ids), "only") if ids else out["only"].append(note[2:])
        else:
            out["unresolved"].append(note)
    take(re.sub(r"[(（][^()（）]*[)）]", "", body), "included")
    if out["included"] and not out["unresolved"]:
        out["status"] = "parsed"
    return out


@F.pandas_udf(SCOPE)
def parse_scope(s: pd.Series) -> pd.DataFrame:
    """``scope_of`` per row; bracket nesting and inherited stems are beyond regular expressions."""
    return pd.DataFrame([scope_of(x) for x in s], columns=[f.name for f in SCOPE])


def scope_decision(clause: Column, included: Column, excluded: Column) -> Column:
    """excluded before included before out_of_scope."""
    hit = lambda ids: F.exists(ids, lambda i: is_within(clause, i))
    return F.when(hit(excluded), "excluded").when(hit(included), "included").otherwise("out_of_scope")
