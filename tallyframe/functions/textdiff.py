"""Order-sensitive text similarity and differences, batched through Arrow (no built-in has these semantics)."""

from __future__ import annotations

import bisect
import difflib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAN = re.compile(r"[一-鿿]+")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|\s+|.")
SEGMENT = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
# fixed values: how long and how many the misread spans of a text may be
SLIP_CHARACTERS, SLIP_SPANS = 3, 8


def ratio_of(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio; depends on the order of the two texts, unlike an edit distance."""
    return pd.Series([ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


GRAM = 5
# fixed value: pairs in runs listed at once; beyond it difflib finds the blocks
RUNS = 2_000_000


def counted(text: str) -> tuple:
    """The distinct letters of a text and their counts, and those of its grams (hashed: a collision can only let a pair pass)."""
    t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(t) - GRAM + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + t[i : i + n]
    return np.unique(t, return_counts=True), np.unique(h, return_counts=True)


def common(x: tuple, y: tuple) -> int:
    """Values in common, counted as often as they are in both."""
    (k, n), (m, c) = (x, y) if len(x[0]) < len(y[0]) else (y, x)
    if not len(k):
        return 0
    at = np.minimum(np.searchsorted(m, k), len(m) - 1)
    return int(np.where(m[at] == k, np.minimum(n, c[at]), 0).sum())


def may_reach(a: str, b: str, least: float, known: dict | None = None) -> bool:
    """False only where the matching-block ratio is certainly below ``least``: by lengths, by letters, by shared grams.

    Blocks of M characters in all, of T in both texts, leave T - 2M characters without a
    partner. M is at most the letters in common, and each character without a partner
    breaks at most GRAM grams of its own text and GRAM - 1 of the other one. ``known``
    keeps the counts of texts.
    """
    total = len(a) + len(b)
    need = least * total / 2
    if min(len(a), len(b)) < need:
        return False
    known = {} if known is None else known
    for t in (a, b):
        if t not in known:
            known[t] = counted(t)
    (x, g), (y, h) = known[a], known[b]
    return common(x, y) >= need and common(g, h) >= (2 * GRAM - 1) * need - (GRAM - 1) * (total + 1)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Blocks:
    """The longest blocks of a ``difflib.SequenceMatcher`` without junk, whose blocks grow from runs of rare characters.

    Pairs of equal rare characters that follow such a pair are listed; where a part of the texts
    has none of them, the first pair of equal rare characters counts, or else what both parts begin with.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        if max(a.max(initial=0), b.max(initial=0)) >= 1 << 16:
            both = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
            a, b = both[: len(a)], both[len(a) :]
        kinds = int(max(a.max(initial=0), b.max(initial=0))) + 1
        count = np.bincount(b, minlength=kinds)
        rare = (count > 0) & (count <= (len(b) // 100 + 1 if len(b) >= 200 else len(b)))
        i, j = np.flatnonzero(rare[a]), np.flatnonzero(rare[b])
        self.rare = list(zip(i.tolist(), a[i].tolist(), strict=True))
        self.rare_at = i
        self.places: dict[int, list[int]] = {}
        for c, x in zip(b[j].tolist(), j.tolist(), strict=True):
            self.places.setdefault(c, []).append(x)
        # pairs by their characters and those before, in the order of i, then of j
        i, j = i[1:][np.diff(i) == 1], j[1:][np.diff(j) == 1]
        x, y = (t[k - 1].astype(np.int64) * kinds + t[k] for t, k in ((a, i), (b, j)))
        order = np.argsort(y, kind="stable")
        y, j = y[order], j[order]
        low = np.searchsorted(y, x)
        each = np.searchsorted(y, x, "right") - low
        self.size = int(each.sum())
        if self.size > RUNS:
            return
        self.i = np.repeat(i, each)
        j = j[np.repeat(low - np.cumsum(each) + each, each) + np.arange(self.size)]
        self.j, self.shift = j, self.i - j
        # where the run that ends with a pair begins
        run = np.lexsort((self.i, self.shift))
        fresh = np.ones(self.size, bool)
        fresh[1:] = (np.diff(self.shift[run]) != 0) | (np.diff(self.i[run]) != 1)
        self.first = np.empty(self.size, np.int64)
        if self.size:
            self.first[run] = self.i[run][fresh][np.cumsum(fresh) - 1] - 1

    def find_longest_match(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        x, y, k = self.longest_run(alo, ahi, blo, bhi) or self.first_pair(alo, ahi, blo, bhi) or (alo, blo, 0)
        back = min(x - alo, y - blo)
        if back:
            differs = np.flatnonzero(self.a[x - back : x] != self.b[y - back : y])
            back = back - 1 - int(differs[-1]) if len(differs) else back
        on = min(ahi - x - k, bhi - y - k)
        if on:
            differs = np.flatnonzero(self.a[x + k : x + k + on] != self.b[y + k : y + k + on])
            on = int(differs[0]) if len(differs) else on
        return x - back, y - back, back + k + on

    def longest_run(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
        low, high = np.searchsorted(self.i, (alo, ahi)).tolist()
        if low == high:
            return None
        i, j = self.i[low:high], self.j[low:high]
        size = i + 1 - np.maximum(np.maximum(self.first[low:high], alo), self.shift[low:high] + blo)
        size[(j < blo) | (j >= bhi)] = 0
        best = int(size.argmax())
        k = int(size[best])
        return (int(i[best]) + 1 - k, int(j[best]) + 1 - k, k) if k > 1 else None

    def first_pair(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
        for at in range(int(np.searchsorted(self.rare_at, alo)), len(self.rare)):
            i, c = self.rare[at]
            if i >= ahi:
                return None
            js = self.places.get(c, ())
            k = bisect.bisect_left(js, blo)
            if k < len(js) and js[k] < bhi:
                return i, js[k], 1
        return None


def ratio_or_less(a: str, b: str, least: float) -> float | None:
    """The matching-block ratio if it is at least ``least``, else null: ends as soon as the blocks to come can't reach it."""
    total = len(a) + len(b)
    finder = Blocks(points_of(a), points_of(b))
    if finder.size > RUNS:
        finder = difflib.SequenceMatcher(None, a, b)
    matched, open_, parts = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while parts and total and 2.0 * (matched + open_) / total >= least:
        alo, ahi, blo, bhi = parts.pop()
        i, j, k = finder.find_longest_match(alo, ahi, blo, bhi)
        open_ -= min(ahi - alo, bhi - blo)
        matched += k
        if k:
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                least_side = min(part[1] - part[0], part[3] - part[2])
                if least_side:
                    open_ += least_side
                    parts.append(part)
    out = 2.0 * (matched + open_) / total if total else 1.0
    return out if out >= least else None


def ratio_from(least: float):
    """``ratio`` where it is ``least`` or more, else null."""

    @F.pandas_udf(T.DoubleType())
    def bounded(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_or_less(x, y, least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return bounded


# fixed values: letters by their code modulo this; grams of cells with and without texts below SHORT_TEXT
LETTERS, SHORT_GRAM, LONG_GRAM, SHORT_TEXT = 64, 4, 8, 400


def rare(t: np.ndarray) -> int:
    """How many characters of a text may begin a block of the matcher if the text comes second: long texts lose their frequent letters."""
    if len(t) < 200:
        return len(t)
    c = np.bincount(t) if t.max() < 1 << 16 else np.unique(t, return_counts=True)[1]
    return int(c[c <= len(t) // 100 + 1].sum())


def signature(t: np.ndarray, gram: int, bits: int) -> np.ndarray:
    """A text's grams of 4 or 8 characters as bits of 2**bits, in words of 64."""
    h = t.astype(np.uint64)
    for step in (1, 2, 4)[: gram.bit_length() - 1]:
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ h[:-step] >> np.uint64(29)) + h[step:]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    table = np.zeros(1 << bits, bool)
    table[(h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)] = True
    return np.packbits(table).view(np.uint64)


def near_in_cell(ids: np.ndarray, texts: list[str], short: np.ndarray, long: np.ndarray, least: float):
    """(i, j) of a short and a long text that may reach ``least``: by lengths, by letters and by shared grams, a text against many.

    Blocks of M characters in all break at most M into grams less (gram - 1) a block. There is
    at most one block more than characters without a partner (as in ``may_reach``), and one more
    than rare characters of the second text: the matcher begins a block at one of these, or where
    both texts begin. A gram whose bit the other text lacks isn't shared. The texts come by
    rising length. Of equal lengths the smaller id counts as the shorter.
    """
    n = np.array([len(t) for t in texts], np.int64)
    gram = SHORT_GRAM if n[0] < SHORT_TEXT else LONG_GRAM
    bits = max(10, (4 * int(n[-1])).bit_length())
    letters, signs, seeds = np.zeros((len(n), LETTERS), np.int32), np.zeros((len(n), 1 << bits - 6), np.uint64), np.zeros(len(n), np.int64)
    for x, text in enumerate(texts):
        t = points_of(text)
        letters[x], signs[x], seeds[x] = np.bincount(t % np.uint32(LETTERS), minlength=LETTERS), signature(t, gram, bits) if len(t) >= gram else 0, rare(t)
    count, marks = np.maximum(n - gram + 1, 0), np.bitwise_count(signs).sum(1, dtype=np.int64)
    for i in np.flatnonzero(short).tolist():
        low, high = np.searchsorted(n, n[i]), np.searchsorted(n, (2 / least - 1) * n[i] + 1, "right")
        j = low + np.flatnonzero(long[low:high] & ((n[low:high] > n[i]) | (ids[low:high] > ids[i])))
        j = j[2 * n[i] >= least * (n[j] + n[i])]
        j = j[np.minimum(letters[j], letters[i]).sum(1) >= least * (n[j] + n[i]) / 2]
        for at in range(0, len(j), 256):  # a few at a time, so that the words stay in cache
            k = j[at : at + 256]
            need = least * (n[k] + n[i]) / 2
            shared = need - (gram - 1) * (1 + np.minimum(n[k] + n[i] - 2 * need, np.maximum(seeds[k], seeds[i])))
            both = np.bitwise_count(signs[k] & signs[i]).sum(1, dtype=np.int64)
            lacks = np.maximum(marks[i] - count[i], marks[k] - count[k]) - both
            for x in k[lacks <= -shared].tolist():
                yield i, x


def near_in_cells(least: float):
    """For mapInArrow: (first_id, doc_id, a, b) of pairs that may reach ``least``.

    Rows (cell, id, m, short, long, text) come in the order of cell, length, id, m; equal rows count once.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows and held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
                yield from of(pa.Table.from_batches(held))
                held = []
            if batch.num_rows and batch.column(0)[0].as_py() != batch.column(0)[-1].as_py():
                rows = pa.Table.from_batches([*held, batch])
                names = rows.column(0).to_pylist()
                last = names.index(names[-1])
                yield from of(rows.slice(0, last))
                held = rows.slice(last).to_batches()
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield from of(pa.Table.from_batches(held))

    def of(rows):
        rows = rows.combine_chunks()  # else each cell's take would join the chunks again
        keys = list(zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True))
        fresh = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        edge = [x for x, i in enumerate(fresh) if not x or keys[i][0] != keys[fresh[x - 1]][0]] + [len(fresh)]
        out: list[list] = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = rows.take(fresh[a:b])
            ids, short, long = (part.column(c).to_numpy() for c in (1, 3, 4))
            if not short.any() or b - a < 2:
                continue
            texts = part.column(5).to_pylist()
            for i, j in near_in_cell(ids, texts, short, long, least):
                first, second = (i, j) if ids[i] < ids[j] else (j, i)
                out.append([int(ids[first]), int(ids[second]), texts[first], texts[second]])
                if len(out) == 500:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["first_id", "doc_id", "a", "b"])

    return run


def segments_of(a: str, b: str) -> list[dict]:
    """Changed token runs between two texts."""
    x, y = TOKEN.findall(a), TOKEN.findall(b)
    steps = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [{"op": op, "left": "".join(x[i:j]), "right": "".join(y[k:m])} for op, i, j, k, m in steps if op != "equal"]


@F.pandas_udf(SEGMENT)
def segments(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([segments_of(x or "", y or "") for x, y in zip(a, b, strict=True)])


def wording_of(a: str, b: str, limit: int = 4) -> list[dict]:
    """Differences of at most ``limit`` characters in which only Han characters change."""
    steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    out = [{"op": op, "left": a[i:j], "right": b[k:m]} for op, i, j, k, m in steps if op != "equal"]
    small = all(len(d["left"]) <= limit and len(d["right"]) <= limit and HAN.fullmatch(d["left"] + d["right"]) for d in out)
    return out if out and small else []


@F.pandas_udf(SEGMENT)
def wording_differences(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([wording_of(x or "", y or "") for x, y in zip(a, b, strict=True)])


def slips_of(reading: str, reference: str) -> bool:
    """The texts differ in a few short spans only, none of which may be two values: digits on both sides, or letters on both."""
    left, right = (MARKS.sub("", re.sub(r"\s+", "", t)) for t in (reading, reference))
    spans = [d for d in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes() if d[0] != "equal"]
    if not left or not right or not 0 < len(spans) <= SLIP_SPANS:
        return False
    letters = re.compile("[A-Za-z]+")
    for _, i, j, k, m in spans:
        x, y = left[i:j], right[k:m]
        two_numbers = any(c.isdigit() for c in x) and any(c.isdigit() for c in y)
        if max(len(x), len(y)) > SLIP_CHARACTERS or two_numbers or (letters.fullmatch(x) and letters.fullmatch(y)):
            return False
    return True


@F.pandas_udf(T.BooleanType())
def is_recognition_slip(reading: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([slips_of(x or "", y or "") for x, y in zip(reading, reference, strict=True)])


BULLET = re.compile(r"^\s*(?:[-–—•·*]|\(?[0-9a-z]{1,2}[)）.、])\s*")
MARKS = re.compile(r"(?<![0-9])\.|\.(?![0-9])|[、，,。；;：:！!？?（）()\[\]【】\"'“”‘’]")


def equivalence_of(a: str | None, b: str | None) -> str | None:
    """Name of the first reduction that makes two texts equal (identical, space, marks, bullets, order); null if none does.

    Numbers are never reduced: a decimal point between digits stays.
    """
    x, y = a or "", b or ""
    lines = lambda t: [line for line in (re.sub(r"\s+", "", MARKS.sub("", BULLET.sub("", s))) for s in t.split("\n")) if line]
    for name, reduce in (
        ("identical", lambda t: t),
        ("space", lambda t: re.sub(r"\s+", "", t)),
        ("punctuation", lambda t: re.sub(r"\s+", "", MARKS.sub("", t))),
        ("bullets", lambda t: "".join(lines(t))),
        ("line_order", lambda t: sorted(lines(t))),
    ):
        if reduce(x) == reduce(y):
            return name
    return None


@F.pandas_udf(T.StringType())
def equivalence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([equivalence_of(x, y) for x, y in zip(a, b, strict=True)], dtype="object")


def containment_of(parts: list[str], container: str, least: int, coverage: float) -> bool:
    """The parts occur once each, in order, and cover enough of the container."""
    at, held = 0, 0
    for p in parts:
        if len(p) < least or container.count(p) != 1:
            return False
        found = container.find(p, at)
        if found < 0:
            return False
        at, held = found + len(p), held + len(p)
    return bool(parts) and held >= coverage * len(container)


@F.pandas_udf(T.BooleanType())
def ordered_containment(parts: pd.Series, container: pd.Series) -> pd.Series:
    """Parts of at least 4 characters that cover 0.8 of the container, in order."""
    return pd.Series([containment_of(list(p) if p is not None else [], c or "", 4, 0.8) for p, c in zip(parts, container, strict=True)])


FACT = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("value", T.StringType()), T.StructField("unit", T.StringType())]))
# fixed values: prefixes and base units of the fact parser, with powers of ten
PREFIXES = {"": 0, "k": 3, "M": 6, "G": 9, "m": -3, "c": -2, "μ": -6, "u": -6, "n": -9, "p": -12}
BASES = ("Hz", "Pa", "Ω", "A", "V", "W", "F", "s", "m", "g", "N", "L", "J")
_FACT = re.compile(r"(?P<op>[<>≤≥±]=?|不大于|不小于|不超过|至少)?\s*(?P<n>[+-]?\d+(?:\.\d+)?)\s*(?P<u>(?:%|°C|(?:[kMGmcμunp]?(?:Hz|Pa|Ω|A|V|W|F|s|m|g|N|L|J))(?:[23²³])?(?:[·/](?:[kMGmcμunp]?(?:Hz|Pa|Ω|A|V|W|F|s|m|g|N|L|J))(?:[23²³])?)*)(?![A-Za-z]))?")
_OPERATORS = {"不大于": "<=", "不超过": "<=", "≤": "<=", "不小于": ">=", "至少": ">=", "≥": ">="}


def _power(unit: str) -> tuple[int, str]:
    """Power of ten and base of one factor such as cm3."""
    unit = unit.replace("²", "2").replace("³", "3")
    n = int(unit[-1]) if unit[-1] in "23" else 1
    name = unit.rstrip("23")
    base = next((b for b in BASES if name.endswith(b) and name[: -len(b)] in PREFIXES), None)
    if base is None:
        return 0, unit
    return PREFIXES[name[: -len(base)]] * n, base + (f"^{n}" if n > 1 else "")


def facts_of(text: str | None) -> list[dict]:
    """Numbers with comparator and unit, in base units and in the order of the text."""
    from decimal import Decimal

    out = []
    for m in _FACT.finditer((text or "").replace("µ", "μ").replace("Ω", "Ω").replace("℃", "°C")):
        shift, names = 0, []
        for i, factor in enumerate(re.split(r"(?=[·/])", m["u"] or "")):
            if not factor or factor in ("%", "°C"):
                names.append(factor)
                continue
            sign = -1 if factor[0] == "/" else 1
            p, name = _power(factor.lstrip("·/"))
            shift += sign * p
            names.append(("/" if sign < 0 else "·" if i else "") + name)
        value = Decimal(m["n"]).scaleb(shift).normalize()
        out.append({"op": _OPERATORS.get(m["op"], m["op"] or "="), "value": f"{value:f}", "unit": "".join(names)})
    return out


@F.pandas_udf(FACT)
def numeric_facts(text: pd.Series) -> pd.Series:
    return pd.Series([facts_of(x) for x in text])


# fixed values: verdicts of two printed units, and torque units printed without their point
UNIT_REASONS = ("EXACT_UNIT_MATCH", "UNIT_PEAK_SEMANTICS_UNRESOLVED", "UNIT_SPELLING_DIFFERENCE", "UNIT_PEAK_SUFFIX_EQUIVALENT", "UNIT_SI_EQUIVALENT", "UNIT_SCALE_MISMATCH", "UNIT_DIMENSION_MISMATCH")
TORQUE = {"Nm": "N·m", "Ncm": "N·cm", "Nmm": "N·mm"}
_SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹µΩ", "0123456789μΩ")


def unit_label(unit: str | None) -> str:
    """A printed unit in one spelling; its scale stays."""
    label = re.sub(r"[\s^]", "", (unit or "").translate(_SUPERSCRIPTS))
    return TORQUE.get(label, label)


def unit_product(label: str) -> tuple[int, str] | None:
    """Power of ten and base units of factors joined by points; null if one isn't known."""
    power, names = 0, []
    for factor in label.split("·"):
        shift, base = _power(factor)
        if re.sub(r"\^[0-9]+$", "", base) not in BASES:
            return None
        power, names = power + shift, [*names, base]
    return power, "·".join(names)


def unit_relation_of(left: str | None, right: str | None, peak_context: bool = False) -> dict:
    """Whether two printed units are one, and why; another scale of one dimension is never taken for equal."""
    a, b = unit_label(left), unit_label(right)
    litre = lambda u: re.sub(r"^([mμn]?)l$", r"\1L", u)
    peaks = [u.endswith("p") and len(u) > 1 for u in (a, b)]
    products = [unit_product(u[:-1] if peak else u) for u, peak in zip((a, b), peaks, strict=True)]
    exact, unresolved, spelling, suffix, same, scale, dimension = UNIT_REASONS
    if litre(a) == litre(b):
        reason = exact
    elif peaks[0] != peaks[1] and not peak_context:
        reason = unresolved
    elif None in products:
        reason = spelling
    elif products[0] == products[1]:
        reason = suffix if peaks[0] != peaks[1] else same
    else:
        reason = scale if products[0][1] == products[1][1] else dimension
    return {"equal": reason in (exact, suffix, same), "reason": reason}


@F.pandas_udf(T.StructType([T.StructField("equal", T.BooleanType()), T.StructField("reason", T.StringType())]))
def unit_relation(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    known: dict = {}
    pairs = list(zip(left, right, strict=True))
    return pd.DataFrame([known.get(p) or known.setdefault(p, unit_relation_of(*p)) for p in pairs], columns=["equal", "reason"])


def few_characters_of(left: str, right: str, least: int = 12, most: int = 2) -> bool:
    """Long cells of which at most ``most`` characters differ on either side."""
    spans = [d for d in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes() if d[0] != "equal"]
    changed = [sum(j - i for _, i, j, _, _ in spans), sum(m - k for _, _, _, k, m in spans)]
    return min(len(left), len(right)) >= least and bool(spans) and max(changed) <= most


@F.pandas_udf(T.BooleanType())
def few_characters_differ(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([few_characters_of(x or "", y or "") for x, y in zip(left, right, strict=True)])


def lines_moved_of(lines: list[str], text: str) -> bool:
    """The text is the lines with one run of whole lines (of four characters or more) at another place."""
    parts = [x for x in (MARKS.sub("", re.sub(r"\s+", "", line)) for line in lines) if x]
    whole = MARKS.sub("", re.sub(r"\s+", "", text))
    n = len(parts)
    if "".join(parts) == whole or len("".join(parts)) != len(whole):
        return False
    for i in range(n):
        for j in range(i + 1, n + 1):
            run, rest = "".join(parts[i:j]), "".join(parts[:i] + parts[j:])
            at = whole.find(run)
            if len(run) >= 4 and rest and at >= 0 and whole.find(run, at + 1) < 0 and whole[:at] + whole[at + len(run) :] == rest:
                return True
    return False


@F.pandas_udf(T.BooleanType())
def lines_moved(lines: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([lines_moved_of(list(x) if x is not None else [], y or "") for x, y in zip(lines, text, strict=True)])
