import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyframe.llm import packing as op
from tests.llm.cases import documents, empty, frame


def best_fit(sizes, capacity):
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if fits:
            bins[min(fits, key=lambda b: (bins[b], b))] -= s
        else:
            bins.append(max(capacity, s) - s)
    return sorted(bins)


def test_runs_pack_like_items():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 200))]
        rows = op.pack(list(Counter(sizes).items()), 100)
        room: dict[int, int] = defaultdict(lambda: 100)
        for size, first, end, number in rows:
            room[number] -= size * (end - first)
        assert sorted(room.values()) == best_fit(sizes, 100)


def test_classes_are_exact_below_the_limit_and_never_smaller(spark):
    sizes = [1, 2, 4095, 4096, 4097, 99_999, 2**40 + 1]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(op.size_class(F.col("s"))).collect()]
    assert got[:4] == sizes[:4]
    assert all(s <= c <= s * (1 + 2**-11) + 1 for s, c in zip(sizes, got, strict=True))


def test_documents(spark):
    rows = documents(n=300)
    got = op.shard_documents(frame(spark, rows), 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= r.shard < 4 for r in got)


def test_shards_are_near_equal_and_groups_whole(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(200)) for i in range(1500)] + [(5000 + i, "the same text") for i in range(800)]
    got = op.shard_documents(frame(spark, rows), 8).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    hot = zlib.crc32(b"the same text")
    assert all(len(s) == 1 for c, s in shards.items() if c != hot)


def test_fixed_capacity_opens_as_few_as_best_fit(spark):
    rows = [(i, "y" * (i % 50) + str(i)) for i in range(120)]
    got = op.shard_documents(frame(spark, rows), capacity=400).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= 400
    assert len(load) == len(best_fit([len(t) + 1 for _, t in rows], 400))


def test_groups_up_to_a_shard_stay_whole_in_a_skewed_table(spark):
    copies = {"a" * 99: 70, "b" * 49: 100, "c" * 199: 20, "d" * 99: 30, "e" * 9: 90}  # 7000, 5000, 4000, 3000, 900 bytes
    rows = [(i, text) for i, text in enumerate(t for t, n in copies.items() for _ in range(n))]
    rows += [(1000 + i, f"{i:0{20 + i % 60}d}") for i in range(300)]
    shards = 4
    mean = sum(len(t) + 1 for _, t in rows) // shards
    assert 7000 < mean
    got = op.shard_documents(frame(spark, rows), shards).collect()
    found, load = defaultdict(set), Counter()
    for r in got:
        found[r.text_crc32].add(r.shard)
        load[r.shard] += r.size
    assert len(got) == len(rows) and all(len(s) == 1 for s in found.values())
    assert max(load.values()) <= 1.02 * mean


def test_only_groups_beyond_the_capacity_are_cut_and_into_few_parts(spark):
    rows = [(i, "x" * 9) for i in range(1000)] + [(2000 + i, "y" * 49) for i in range(8)] + [(3000 + i, f"{i:029d}") for i in range(50)]
    got = op.shard_documents(frame(spark, rows), capacity=400).collect()
    load, found = Counter(), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        found[r.text_crc32].add(r.shard)
    assert len(got) == len(rows) and max(load.values()) <= 400
    assert len(found[zlib.crc32(b"x" * 9)]) == 25
    assert all(len(s) == 1 for c, s in found.items() if c != zlib.crc32(b"x" * 9))


def test_empty_table(spark):
    assert op.shard_documents(empty(spark)).count() == 0
