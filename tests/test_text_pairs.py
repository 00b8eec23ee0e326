import difflib
import random

import numpy as np

from tallyframe.functions import textdiff
from tallyframe.plans import registry  # noqa: F401  (loads the plans in their order)
from tallyframe.plans import reconciliation as op


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choices("abcdé ", k=rng.randrange(3))
    return "".join(out)


def rows():
    """Headings whose smallest id is far from the rest; near texts, copies and nulls."""
    rng = random.Random(11)
    out, number = [], 0
    for h in ("one", "two", ""):
        bodies = ["".join(rng.choices("abcdefg  ", k=9))]
        for size in (30, 90, 140, 300):
            base = "".join(rng.choices("abcdefgh  ", k=size))
            bodies += [base, base, *(edited(rng, base, size * k // 50) for k in range(5))]
        for b in bodies:
            out.append((number, f"{h}\n{b}", h))
            number += 1
    return [*out, (900, None, None), (901, "alone", "alone")]


def test_all_pairs_of_a_heading(spark):
    data = rows()
    first = {}
    for d, t, _ in data:
        first.setdefault(t, d)
    want = {(first[t], d, 1.0) for d, t, _ in data if t is not None and first[t] != d}
    for d, t, h in data:
        for e, u, g in data:
            if h == g and h is not None and d < e and first[t] == d and first[u] == e:
                ratio = round(difflib.SequenceMatcher(None, t, u).ratio(), 4)
                if ratio >= 0.94:
                    want.add((d, e, ratio))
    got = op.near_texts(spark.createDataFrame(data, "doc_id long, text string, heading string"), 0.94).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(a > 0 and r < 1 for a, _, r in want) and any(r == 1 for *_, r in want)


def test_the_bound_never_rules_out_a_pair():
    rng = random.Random(12)
    for _ in range(400):
        a = "".join(rng.choices("abcdé ", k=rng.randrange(1, 80)))
        b = edited(rng, a, rng.randrange(6))
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert all(textdiff.may_reach(a, b, least) for least in (0.5, 0.8, 0.94) if ratio >= least)


def test_a_cell_keeps_every_pair_and_few_others():
    rng = random.Random(13)
    texts = []
    for size in (1, 3, 40, 200, 900):
        for _ in range(6):
            base = "".join(rng.choices("abcdefgh  ", k=size))
            texts += [base, edited(rng, base, size // 40), edited(rng, base, size // 20)]
    texts = sorted({*texts, ""}, key=lambda t: (len(t), t))
    ids = np.array(rng.sample(range(1000), len(texts)))
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), ids[i]))
    ids, texts = ids[order], [texts[i] for i in order]
    every = np.ones(len(texts), bool)
    got = list(textdiff.near_in_cell(ids, texts, every, every, 0.94))
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if max(difflib.SequenceMatcher(None, *p).ratio() for p in ((texts[i], texts[j]), (texts[j], texts[i]))) >= 0.94}
    assert len(got) == len(set(got)) and near and near <= set(got)
    assert sum(len(texts[i]) > 30 for i, _ in got) <= 2 * len([p for p in near if len(texts[p[0]]) > 30]) + 40


def test_ratios_are_taken_once_in_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(op, "CELL_PAIRS", 20)  # several cells
    docs = spark.createDataFrame(rows(), "doc_id long, text string, heading string")
    plan = op.near_texts(docs, 0.94)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    test_all_pairs_of_a_heading(spark)


def prose(rng, size):
    out = []
    while sum(map(len, out)) < size:
        words = ["".join(rng.choices(("the", "and", "ti", "on", "er", "es", "hea", "in", "ou"), k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 16))]
        out.append(" ".join(words).capitalize() + rng.choice((". ", ", ", ".\n")))
    return "".join(out)[:size]


def test_long_texts_of_common_words_are_no_possible_pairs():
    rng = random.Random(14)
    texts = [prose(rng, 6000 + 20 * k) for k in range(12)]
    texts.append(texts[-1].replace("Ti", "Tihea", 1))
    every = np.ones(len(texts), bool)
    assert list(textdiff.near_in_cell(np.arange(len(texts)), texts, every, every, 0.94)) == [(11, 12)]


def test_the_bounded_ratio_is_the_matchers():
    rng = random.Random(15)
    han, wide = ([chr(first + k) for k in range(300)] for first in (0x4E00, 0x1F300))
    pairs = [("", ""), ("", "a"), ("a", "")]
    for letters in ("ab", "abcdefgh  ", list("abcdefghijklmnopqrstuvwxyz.,:é0123456789" + "e " * 30), han, wide):
        for size in (1, 30, 199, 200, 201, 900):
            for edits in (0, 1, size // 100, size // 20, size):
                a = "".join(rng.choices(letters, k=size))
                pairs.append((a, edited(rng, a, edits)))
    pairs += [(prose(rng, 2000), prose(rng, 2000)), *((t, edited(rng, t, 9)) for t in (prose(rng, 3000) for _ in range(9)))]
    for a, b in pairs:
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        for least in (0.0, 0.5, 0.9399, ratio):
            assert textdiff.ratio_or_less(a, b, least) == (ratio if ratio >= least else None)


def test_many_runs_are_left_to_difflib(monkeypatch):
    monkeypatch.setattr(textdiff, "RUNS", 3)
    rng = random.Random(16)
    for _ in range(20):
        a = "".join(rng.choices("abc ", k=60))
        b = edited(rng, a, 3)
        assert textdiff.ratio_or_less(a, b, 0.0) == difflib.SequenceMatcher(None, a, b).ratio()
