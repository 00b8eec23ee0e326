import collections
import math
import re
import zlib

import numpy as np
import pytest

from tallyframe.llm import bloom_lm as op
from tests.llm.cases import documents, empty, frame


def base_scores(rows):
    fold = {i: i + 32 for i in range(65, 91)}
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)), None] for _, t in rows]
    out = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    counts = collections.Counter(w for t, held in zip(texts, out, strict=True) if not held for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(d, held, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for (d, _), t, held in zip(rows, texts, out, strict=True)]


@pytest.mark.parametrize("table_words", [10**6, 20, 0])
def test_base_is_exact_whatever_is_broadcast(spark, table_words):
    rows = documents()
    got = op.score_documents(frame(spark, rows), table_words=table_words, bucket_bytes=1 << 12).collect()
    key = lambda r: (str(r[:5]), round(r[5], 6))
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(base_scores(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert all(r.score <= 0 for r in got)


def test_pairs_seen_in_training_help(spark):
    rows = [(i, f"alpha beta gamma{i % 3} delta") for i in range(60)]
    got = op.score_documents(frame(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.score > r.base_score for r in held)


def test_filter_gives_levels_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64))
    counts = np.random.default_rng(2).integers(1, 5000, len(keys))
    q = op.quantise(counts)
    stored = op.LogFilter({(1, 0): op.LogFilter.build(keys, q, 1, 12)}, 0, 1)
    got = stored.level(1, keys)
    assert (got >= q).all() and (got == q).mean() > 0.97
    assert (stored.level(1, keys + np.uint64(1)) == 0).mean() > 0.97


def test_counts_survive_packing():
    counts = np.array([1, 254, 255, 256, 10**12])
    assert op.unpack_counts(op.pack_counts(counts), 5).tolist() == counts.tolist()
    for q, value in enumerate(op.VALUES[1:30], 1):
        whole = [c for c in range(1, 3000) if op.quantise(np.array([c]))[0] == q]
        if whole and max(whole) < 2900:
            assert min(whole) <= value <= max(whole)


def test_a_small_filter_and_an_empty_table(spark):
    rows = documents()
    small = op.score_documents(frame(spark, rows), filter_bytes=64).collect()
    assert len(small) == len(rows)
    assert op.score_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("filter_bytes", [128 << 20, 64])
def test_scores_use_every_count_whatever_the_filter_needs(spark, filter_bytes):
    rows = documents()
    fold = {i: i + 32 for i in range(65, 91)}
    texts = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)), "</s>"] for _, t in rows]
    train = [x for x, (d, _) in zip(texts, rows, strict=True) if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    words = collections.Counter(w for x in train for w in x[1:])
    words["<s>"] = words["</s>"]
    pairs = collections.Counter(p for x in train for p in zip(x, x[1:], strict=False))
    n = sum(len(x) - 1 for x in train)
    value = lambda c: op.VALUES[op.quantise(np.array([c]))[0]] if c else 0.0

    def p(u, w):
        single = (value(words[w]) + 0.5) / (n + 0.5 * len(words))
        return 0.1 * min(value(pairs[u, w]) / value(words[u]), 1) + 0.9 * single if pairs[u, w] else single

    want = [(str(d), len(x) - 1, sum(math.log10(p(u, w)) for u, w in zip(x, x[1:], strict=False))) for x, (d, _) in zip(texts, rows, strict=True)]
    got = op.score_documents(frame(spark, rows), filter_bytes=filter_bytes, bits_per_item=64, bucket_bytes=1 << 12).collect()
    for a, b in zip(sorted((str(r.doc_id), r.n_tokens, r.score) for r in got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)


def test_a_filter_beyond_the_broadcast_bound_scores_alike(spark, monkeypatch):
    monkeypatch.setattr(op, "UNIT_TOKENS", 2000)
    df = frame(spark, documents(n=200))
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    one, other = (sorted(op.score_documents(df, filter_bytes=n, table_words=50, bucket_bytes=1 << 12).collect(), key=key) for n in (128 << 20, 64))
    for a, b in zip(one, other, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
