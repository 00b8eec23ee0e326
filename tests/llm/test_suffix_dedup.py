import hashlib
import random

import numpy as np
import pytest

from tallyframe.llm import suffix_dedup as op
from tests.llm.cases import documents, empty, frame


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def periodic():
    rng = random.Random(8)
    part = "".join(rng.choices("abc", k=90))
    rows = [(1, "z" * 150), (2, "ab" * 90), (3, part + "x" + part), (4, part[10:] + "\0\0y"), (5, part[10:] + "\0"), (6, part[:60] + "é" + part[60:])]
    rows += [(10 + i, "".join(rng.choices("ab", k=i)) + part[i : 90 - i] + "".join(rng.choices("ab", k=9))) for i in range(25)]
    return rows


@pytest.mark.parametrize(("rows", "length", "gram", "hot"), [(documents(), 200, 64, 10**6), (documents(9), 30, 12, 10**6), (documents(9), 30, 12, 4), (periodic(), 20, 8, 10**6), (periodic(), 20, 8, 2)])
def test_agrees_with_all_windows(spark, rows, length, gram, hot):
    got = op.remove_repeats(frame(spark, rows), length=length, gram=gram, hot_rows=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def runs_of_one_character():
    rng = random.Random(4)
    own = lambda n: "".join(rng.choices("abcdefgh", k=n))
    rows = [(i, own(40) + "-" * n + own(40)) for i, n in enumerate((9, 12, 15, 18, 19, 20, 21, 30, 60))]
    rows += [(20 + i, own(30) + "a line of its own\n" * i + own(30)) for i in range(1, 5)]
    return [*rows, (40, own(25) + "-" * 14 + own(25) + "-" * 14 + own(25)), (41, own(50))]


@pytest.mark.parametrize("hot", [10**6, 1])
def test_windows_that_hold_a_gram_twice_count_once(spark, hot):
    rows = runs_of_one_character()
    got = op.remove_repeats(frame(spark, rows), length=20, gram=8, hot_rows=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 20)


@pytest.mark.parametrize(("rows", "length", "gram"), [(documents(9), 30, 12), (periodic(), 20, 8)])
def test_counting_everything_agrees_with_all_windows(spark, rows, length, gram):
    got = op.remove_repeats(frame(spark, rows), length=length, gram=gram, hot_rows=1).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_a_gram_with_over_100_000_anchors_is_sorted(spark, monkeypatch):
    """Runs of one period in many texts: classes of equal surroundings, then the sorting; nothing is counted by windows."""

    def never(*_):
        raise AssertionError("counted by windows")

    monkeypatch.setattr(op, "counted_spans", never)
    rng = random.Random(12)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(i, own(50) + "Is onhe. " * (280 + i % 9) + own(60)) for i in range(400)]
    rows += [(900, "Is onhe. " * 40), (901, own(300)), (902, "x" + "Is onhe. " * 22 + "?")]
    docs = frame(spark, rows)
    anchors = op.anchor_rows(docs.selectExpr("doc_id as k1", "xxhash64(text) as k2", "text"), 200, 64)
    assert anchors.groupBy("hash").count().agg({"count": "max"}).first()[0] > 100_000
    got = op.remove_repeats(docs, length=200).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 200)


def test_kept_text_on_demand(spark):
    part = "0123456789" * 3
    docs = frame(spark, [(1, "left " + part), (2, part + " right")])
    got = {r.doc_id: bytes(r.kept_bytes) for r in op.remove_repeats(docs, length=20, gram=8, with_text=True).collect()}
    assert got == {1: b"left ", 2: b" right"}


def test_deep_shallow_order_is_the_sorted_order():
    rng = random.Random(2)
    base = bytes(rng.choices(range(3), k=100))
    texts = [base[:i] + bytes(rng.choices(range(3), k=100 - i)) for i in (0, 10, 71, 72, 73, 80, 99, 100) for _ in range(9)]
    rng.shuffle(texts)
    group = np.sort(np.array([rng.randrange(3) for _ in texts]))
    order = op.deep_shallow_order(np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 100), group)
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts, strict=True))


def test_empty_table(spark):
    assert op.remove_repeats(empty(spark)).count() == 0
