import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import spaced_seeds as op
from tallyframe.llm.text import Chunk, string_bytes
from tests.llm.cases import documents, empty, frame, words

ITEM = "item_id long, text string, at int, token long"


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEM)


def test_passages_with_substitutions_case_and_punctuation(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, 30, 5000))) for i in range(20)] + [(90, None), (91, ""), (92, "just three words"), (None, " ".join(words(rng, 30, 5000)))]
    rows = documents() + [(500, None)]
    expected = set()
    for i, (item, text) in enumerate(items):
        tokens = (text or "").split()
        if len(tokens) < 3:
            continue
        for k, changed in enumerate((0, 2, 4)):
            if changed and len(tokens) < 10:
                continue
            copy = list(tokens)
            for at in range(changed):
                copy[5 + at * 6] = "zzz"
            body = ", ".join(copy).upper() if k == 1 else " ".join(copy)
            doc = 1000 + i * 10 + k
            rows.append((doc, " ".join(words(rng, 15)) + "\n" + body + " " + " ".join(words(rng, 9))))
            expected.add((doc, item))
        rows.append((2000 + i, " ".join(words(rng, 5)) + " " + " ".join(tokens[:8] if len(tokens) > 8 else tokens[:2])))
    docs, bench = frame(spark, rows), benchmark(spark, items)
    for block in (8 << 20, 400):
        got = {(r.doc_id, r.item_id) for r in op.contaminated(docs, bench, block_bytes=block).collect()}
        assert got == expected
    left = op.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in rows if d not in {d for d, _ in expected}), key=str)


def test_masks_ignore_their_zeros():
    a = np.arange(1, 12, dtype=np.uint64)
    for m, mask in enumerate((*op.MASKS, *op.MIDDLE_MASKS, *op.masks_of(7))):
        h = op.seed_hashes(a[: len(mask)], mask, m)
        for i, c in enumerate(mask):
            b = a[: len(mask)].copy()
            b[i] = 99
            assert (op.seed_hashes(b, mask, m) == h).all() == (c == "0")


@pytest.mark.parametrize("n, substituted", [(5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (15, 3), (20, 4), (25, 5)])
def test_every_accepted_pattern_has_a_hit(n, substituted):
    patterns = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), substituted)])
    hit = np.zeros(len(patterns), bool)
    for mask in op.masks_of(n):
        for at in range(n - len(mask) + 1):
            hit |= patterns & (int(mask[::-1], 2) << at) == 0
    assert hit.all()


def test_random_substitutions_agree_with_all_alignments():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    items = [rng.choices(pool, k=n) for n in (*range(1, 41), 15, 16, 20, 25)] + [["a"] * 12, ["a", "b"] * 9]
    rows = []
    for i, item in enumerate(items):
        for k in range(8):
            copy = list(item)
            for at in rng.sample(range(len(item)), min(len(item), rng.randrange(len(item) // 5 + 2))):
                copy[at] = "zzz"
            copy = copy[rng.choice((0, 0, 1)) : len(copy) - rng.choice((0, 0, 1))]
            rows.append((i * 10 + k, " ".join(rng.choices(pool, k=rng.choice((0, 6))) + copy + rng.choices(pool, k=rng.choice((0, 6))))))
    rows += [(9000, "a " * 300), (9001, "a b " * 100)]
    ids, texts = zip(*rows, strict=True)
    buf, off = string_bytes(pa.array(texts))
    index = op.SeedIndex(list(range(len(items))), [" ".join(x) for x in items])
    got = {r[:4] for r in op.find_overlaps(index, Chunk(pa.array(ids), buf, off), 12, 0.2)}
    want = {}
    for d, text in rows:
        tokens = np.array(text.split())
        for i, item in enumerate(items):
            item = np.array(item)
            need = min(12, -(-4 * len(item) // 5))
            for start in range(1 - len(item), len(tokens)):
                low, high = max(start, 0), min(start + len(item), len(tokens))
                equal = tokens[low:high] == item[low - start : high - start]
                if equal.sum() < need:
                    continue
                a, b, match = op.best_segment(equal)
                if match >= need and 5 * (b - a - match) <= b - a:
                    want[d, i] = max(want.get((d, i), (0, 0)), (match, b - a))
    assert got == {(*k, *v) for k, v in want.items()}


def test_runs_of_hits_give_the_same_alignments():
    index = op.SeedIndex([1], ["a " * 20])
    buf, off = string_bytes(pa.array(["a " * 200, "b c", "a " * 30]))
    starts, ends, woff = op.spans(buf, off)
    hashes = op.word_hashes(buf, starts, ends)
    whole, parts = (np.concatenate(list(index.alignments(hashes, woff, n))) for n in (1 << 20, 50))
    assert (np.unique(parts, axis=0) == whole).all()


def test_best_segment_agrees_with_all_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 15)) < 0.6
        gain = np.where(equal, 1, -2)
        a, b, n = op.best_segment(equal)
        assert gain[a:b].sum() == max(0, *(gain[i:j].sum() for i in range(len(gain)) for j in range(i + 1, len(gain) + 1)))
        assert n == equal[a:b].sum()


def test_empty_tables(spark):
    assert op.contaminated(empty(spark), benchmark(spark, [(1, "a b c d e f g h i j k l m")])).count() == 0
    assert op.contaminated(frame(spark), benchmark(spark, [])).count() == 0
    assert op.drop_contaminated(frame(spark), benchmark(spark, [])).count() == len(documents())
