import random
import re

import numpy as np
import pytest

from tallyframe.llm import ngram_join as op
from tests.llm.cases import documents, empty, frame, words


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None and (sets[i] or j == i)]
        links = sum(j != i and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for j in range(len(rows)))
        out.append((d, len(sets[i]), min(ids, default=None), links))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 5), (5, 80, 6), (2, 60, 7)])
def test_components_agree_with_all_pairs(spark, k, percent, seed):
    rows = documents(seed)
    got = op.similar_documents(frame(spark, rows), k=k, percent=percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, percent)


def test_families_whose_leaders_do_not_link(spark):
    """Members on the near sides of two families link although the leaders don't."""
    rng = random.Random(3)
    left = words(rng, 100, 10**6)
    rows = []
    for i in range(60):
        copy = list(left)
        for j in range(i % 20):
            copy[j] = f"r{j}"
        for _ in range(rng.randrange(3)):
            copy[40 + rng.randrange(60)] = f"q{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(copy)))
    for k, percent in ((1, 85), (3, 85), (1, 90)):
        got = op.similar_documents(frame(spark, rows), k=k, percent=percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, k, percent)


def test_derived_overlaps():
    """Overlaps come out of the leaders' sets and the members' differences alone."""
    rng = random.Random(4)
    leaders = [np.array(sorted(rng.sample(range(60), 30)), np.uint64) for _ in range(2)]
    blocks, texts = [], []
    for leader in leaders:
        own = set(leader.tolist())
        sides = [set(leader.tolist())] + [{w for w in own if rng.random() < 0.8} | {w for w in range(60) if rng.random() < 0.3} for _ in range(6)]
        members = [{"member": i, "size": len(m), "copies": 1} | {c: np.array(sorted(v), np.uint64).tobytes() for c, v in (("gone", own - m), ("more", m - own))} for i, m in enumerate(sides)]
        blocks.append(op.Block.of(members))
        texts.append(sides)
    for i, j in ((0, 1), (0, 0), (1, 1)):
        want = [[len(p & q) for q in texts[j]] for p in texts[i]]
        assert op.derived_overlaps(blocks[i], blocks[j], leaders[i], leaders[j]).tolist() == want


@pytest.mark.parametrize("block", [256, 3])
def test_a_large_family(spark, monkeypatch, block):
    """One group of near copies, cut into several blocks and list cells."""
    monkeypatch.setattr(op, "MEMBERS_PER_BLOCK", block)
    monkeypatch.setattr(op, "CELL", 4 * block)
    rng = random.Random(8)
    base = words(rng, 80, 10**6)
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows += [(i, " ".join(copy))] * (1 + (i % 9 == 0))
    got = op.similar_documents(frame(spark, rows), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2, 80)
    kept = op.keep_one_of_each(frame(spark, rows), k=2, percent=80).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r[2] for r in brute(rows, 2, 80)})


def test_bucket_counts_bound_the_overlap():
    rng = np.random.default_rng(6)
    for n in (3, 40, 700, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, n // 3, dtype=np.uint64) * np.uint64(2)]))
        low = np.unique(np.concatenate([x, np.arange(3 * n, dtype=np.uint64)]))
        for a, b in ((x, y), (x, low), (y, low), (x, x)):
            both = len(np.intersect1d(a, b))
            jaccard = both / (len(a) + len(b) - both)
            for percent in (10, 30, 50, 80, 100):
                may = op.may_link([op.bucket_counts(a)], [op.bucket_counts(b)], np.array([[len(a), len(b)]]), np.zeros(1), percent)[0]
                assert may or 100 * jaccard < percent
    far = np.arange(100, dtype=np.uint64) << np.uint64(40)
    assert not op.may_link([op.bucket_counts(x)], [op.bucket_counts(far)], np.array([[len(x), len(far)]]), np.zeros(1), 50)[0]


def test_bucket_counts_take_half_a_byte_each():
    rng = np.random.default_rng(7)
    for n in (5, 100, 400, 9000):
        assert len(op.bucket_counts(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)))) <= max(8, n // 8)


def test_index_lists_keep_every_entry_with_a_partner(spark):
    """Entries that meet no other family of a fitting size go, before anything is joined to them; no pair goes."""
    rng = random.Random(9)
    rows = [(rng.randrange(12), f, 20 + f % 37 * 3, 5 + rng.randrange(60)) for f in range(150)]
    rows += [r for r in rows if r[1] % 10 == 0] + [(77, 900, 50, 40), (77, 901, 100, 90), (78, 902, 30, 29)]
    found = op.with_partners(spark.createDataFrame(rows, "token long, f1 long, n int, rest int"), 85).collect()
    fits = lambda x, y: 100 * min(x[2], y[2]) >= 85 * max(x[2], y[2])
    want = {x for x in rows if any(x[0] == y[0] and x[1] != y[1] and fits(x, y) for y in rows)}
    lengths = {token: sum(x[0] == token for x in want) for token in range(80)}
    assert want <= {tuple(r)[:4] for r in found} and {r.token for r in found} <= set(range(12))
    assert all(r.length >= lengths[r.token] for r in found) and len(found) == len({r[:2] for r in found})

    lists = [(t, f % 40, n, rest) for t, f, n, rest in rows] + [(80, 1, 100, 99), (80, 2, 100, 3), (81, 1, 100, 99), (81, 2, 101, 98), (82, 1, 100, 99), (82, 1, 101, 99)]
    kept = {tuple(r) for r in op.of_several_families(spark.createDataFrame(lists, "list long, fam long, n int, rest int"), 85).collect()}
    best = {x[:3]: max(y[3] for y in lists if y[:3] == x[:3]) for x in lists}
    once = [(*x, rest) for x, rest in best.items()]
    reach = lambda x, y: fits(x, y) and 1 + min(x[3], y[3]) >= op.needed_overlap(x[2] + y[2], 85)
    assert {x for x in once if any(x[0] == y[0] and x[1] != y[1] and reach(x, y) for y in once)} <= kept <= set(once)
    assert {x[0] for x in kept} & {77, 78, 80, 81, 82} == {81}


def test_rare_shingles_come_first():
    s = np.sort(np.array([10, 20, 2**63 + 5], np.uint64))
    keys = op.sort_keys(s, (np.array([10], np.uint64), np.array([7], np.uint64)))
    assert keys.argmax() == 0 and len(set(keys.tolist())) == 3


def test_one_of_each(spark):
    rows = documents()
    docs = frame(spark, rows)
    got = op.keep_one_of_each(docs, k=4, percent=85)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    expected = [d for d, _, c, _ in brute(rows, 4, 85) if d is not None and d == c]
    assert sorted(x for x in kept if x is not None) == sorted(set(expected))
    assert kept.count(None) == sum(d is None for d, _ in rows)


def test_clashing_columns_and_repeated_ids(spark):
    """Names that the operator could want stay as they are; a repeated id with another text is judged on its own."""
    text = "a b c d e f g h i j"
    rows = [(1, text, 5, True), (2, text, 6, False), (2, "quite another text of its own words", 7, True), (3, None, 8, None), (3, None, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __word int, __possible boolean").selectExpr("*", "'x' as gone", "1 as possible", "2 as n", "3 as f1", "4 as id_")
    got = op.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r["__word"], r["__possible"]) for r in got.collect()) == [(1, 5, True), (2, 7, True), (3, 8, None)]
    once = docs.where("__word < 7")
    assert [(r.doc_id, r["__word"], r["__possible"], r.gone, r.possible) for r in op.keep_one_of_each(once).collect()] == [(1, 5, True, "x", 1)]


def test_empty_table(spark):
    assert op.similar_documents(empty(spark)).count() == 0
    assert op.keep_one_of_each(empty(spark)).count() == 0
