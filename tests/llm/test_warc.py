import base64
import gzip
import hashlib
import random
from collections import defaultdict
from pathlib import Path

import pytest

from tallyframe.llm import store
from tallyframe.llm import warc as op

SCHEMA = "page_id long, url string, html string, n int, sha1 string, first int, shard string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def sample():
    rng = random.Random(4)
    rows = [(i * 7, f"http://h/{i}", "".join(rng.choices("abé<>&\r\n", k=rng.choice([1, 50, 900])))) for i in range(200)]
    rows += [(5000 + i, "http://copy", rows[i % 3][2]) for i in range(40)]
    rows += [(9000, None, None), (9001, "http://x y\r\nbad: 1", ""), (9002, "u", None), (None, "u", "only here"), (None, "u", rows[0][2]), rows[5], rows[5]]
    rows.append((9003, "long", "long text " * 200_000))
    return rows


def expected(rows):
    first = defaultdict(list)
    for p, _, h in rows:
        first[h or ""].append(p)
    first = {h: min((p for p in ids if p is not None), default=None) for h, ids in first.items()}
    out, used = [], set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data, f = (h or "").encode(), first[h or ""]
        own = f is None or (p == f and (p, h or "") not in used)
        used.add((p, h or ""))
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else f))
    return sorted(out, key=str)


def test_round_trip_in_many_shards_and_files(spark):
    rows = sample()
    uri = store.work_dir(spark, "warc")
    got = op.round_trip(pages(spark, rows), uri, shard_bytes=20_000, roll_bytes=4_000)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(rows)
    folder = Path(uri.removeprefix("file:"))
    files = sorted(folder.glob("*.warc.gz"))
    assert len(files) > 10 and not (folder / "_temporary").exists()
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert plain.count(b"WARC/1.1\r\n") == len(rows)


def test_equal_rows_give_equal_bytes(spark):
    rows = sample()
    digests = []
    for n in (3, 7):
        uri = store.work_dir(spark, "warc")
        digests.append(op.write_archives(pages(spark, rows).repartition(n), uri, shard_bytes=20_000, roll_bytes=4_000))
    assert digests[0] == digests[1]


def test_shards_follow_any_spread_of_ids(spark):
    rows = [(i, "u", f"{i} " * 100) for i in range(2000)] + [(10**15, "u", "far"), (-(2**63), "u", "lowest"), (2**63 - 1, "u", "highest")]
    sizes = spark.createDataFrame([(p, len(h)) for p, _, h in rows], "page_id long, n long")
    borders = op.shard_borders(sizes, 50_000)
    held = [0] * (len(borders) + 1)
    for p, _, h in rows:
        held[sum(b <= p for b in borders)] += len(h)
    assert max(held) <= 50_000 and len(held) <= 2 * sum(held) // 50_000 + 2
    uri = store.work_dir(spark, "warc")
    entries = op.write_archives(pages(spark, rows), uri, shard_bytes=50_000)
    assert len({e["shard"] for e in entries}) == len(held)
    assert sorted(r.page_id for r in op.read_archives(spark, uri).select("page_id").collect()) == sorted(p for p, _, _ in rows)


def test_renaming_again_changes_nothing(spark):
    uri = store.work_dir(spark, "warc")
    entries = op.write_archives(pages(spark, [(1, "u", "payload"), (2, "u", "other")]), uri)
    op.rename(spark, uri, [{"temporary": "_temporary/gone", "name": e["name"]} for e in entries])
    assert op.read_archives(spark, uri).count() == 2


def test_small_payloads_may_be_written_each_time(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = op.round_trip(pages(spark, rows), store.work_dir(spark, "warc"), dedupe_from=3)
    assert {r.page_id: r.record_type for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_damage_is_found(spark):
    uri = store.work_dir(spark, "warc")
    op.write_archives(pages(spark, [(1, "u", "payload")]), uri)
    file = next(Path(uri.removeprefix("file:")).glob("*.gz"))
    file.write_bytes(op.gzip_member(gzip.decompress(file.read_bytes()).replace(b"payload", b"pAyload")))
    with pytest.raises(Exception, match="damaged"):
        op.read_archives(spark, uri).collect()


def test_empty_table(spark):
    assert op.round_trip(pages(spark, []), store.work_dir(spark, "warc")).count() == 0
