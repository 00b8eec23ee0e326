"""Deterministic sharded WARC writer and reader.

Records are range-partitioned by page id. A histogram of payload bytes over some
4096 cells of ids gives the shard borders; cells that hold more than a shard are
divided again, down to one id, so that the borders depend on the rows only and
follow any spread of the ids. Each shard is sorted and written as gzip members, one per record; a new file starts
when the compressed size passes ``roll_bytes``. Headers, record ids and digests are
regenerated from the row. The same rows give the same bytes, on any cluster.

Writers use names of their own below ``_temporary``; a task that is run again or
twice leaves files that nobody commits. The files of the successful attempts are
renamed in tasks (one that has its name already is left alone); the driver writes
the manifest under a temporary name and renames it last, so a reader sees all of an archive or none of it. Files are reached through
``pyarrow.fs``, hence the folder may be in any store that it knows.

Equal payloads (by length and SHA-1) are written once, as the response of the
smallest page id; others are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.prefilter import bit_table, with_possible
from tallyframe.llm.store import cut

CELL_BITS, FINER_BITS = 12, 6
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
FILES = "shard long, part long, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, record_id string, file string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; ``file:/x`` is read like ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{copy}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int) -> bytes:
    """One record, uncompressed. ``refers_to`` makes it a revisit without a body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    header = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        header.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        header += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name: equal data gives equal bytes."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Roller:
    """Writes the files of the shards that one task gets, in order."""

    def __init__(self, uri: str, roll_bytes: int):
        self.store, self.root = open_store(uri)
        self.attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.roll_bytes, self.shard, self.part, self.out, self.done = roll_bytes, None, 0, None, []

    def add(self, shard: int, member: bytes) -> None:
        if self.shard != shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.size + len(member) > self.roll_bytes:
            self.close()
            self.part += 1
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{uuid.uuid4().hex}-{self.name}"
            self.out = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.part, self.temporary, self.name, self.records, self.size, self.digest.hexdigest()))
            self.out = None


def shard_borders(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of the second and later shards; ``sizes`` has page_id and n.

    Cells are ids without their last bits. Only those over ``shard_bytes`` are divided,
    so a pass brings at most 64 rows for each shard to the driver.
    """
    rows = sizes.where(F.col("page_id").isNotNull())
    low, high = rows.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return []
    bits, part, cells = max(0, (high - low).bit_length() - CELL_BITS), rows, []
    while True:
        found = part.groupBy(F.shiftright("page_id", bits).alias("cell")).agg(F.sum("n").alias("n")).collect()
        heavy = [r.cell for r in found if bits and r.n > shard_bytes]
        whole = set(heavy)
        cells += [(r.cell << bits, r.n) for r in found if r.cell not in whole]
        if not heavy:
            break
        chosen = sizes.sparkSession.createDataFrame([(c,) for c in heavy], "cell long")
        part = rows.join(F.broadcast(chosen), F.shiftright("page_id", bits) == F.col("cell"), "left_semi")
        bits = max(0, bits - FINER_BITS)
    borders, held = [], 0
    for at, n in sorted(cells):
        if held and held + n > shard_bytes:
            borders.append(at)
            held = 0
        held += n
    return borders


def rename(spark: SparkSession, uri: str, entries: list[dict]) -> None:
    """Give the files of the successful attempts their names; running it again changes nothing."""
    names = spark.createDataFrame([(e["temporary"], e["name"]) for e in entries], "temporary string, name string").repartition(min(len(entries), 256))

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = open_store(uri)
        for batch in batches:
            for temporary, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    names.mapInArrow(run, names.schema).agg(F.count("name")).collect()


def write_archives(pages: DataFrame, uri: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedupe_from: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20) -> list[dict]:
    """Write all rows and commit; gives the manifest's entries. An empty table gives an empty manifest."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    borders = shard_borders(cut(rows.select("page_id", "n")), shard_bytes)
    shard = F.lit(0).cast("long")
    if borders:
        marks = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")
        shard = F.size(F.filter(marks, lambda b: b <= F.coalesce(F.col("page_id"), F.lit(-(2**63))))).cast("long")
    # only payloads that may occur twice are shuffled to learn the smallest id that has them
    first = cut(rows.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    marked = with_possible(rows, "sha1", bit_table(first, "sha1"), "possible")
    single = marked.where("not possible").drop("possible").withColumn("first", F.col("page_id"))
    several = marked.where("possible").drop("possible").join(first, ["sha1", "n"], "left").withColumn("first", F.coalesce("first", "page_id"))
    rows = single.unionByName(several).withColumn("shard", shard)
    rows = rows.repartitionByRange(len(borders) + 1, "shard").sortWithinPartitions("shard", "page_id", "sha1", "n", "url")
    rows = rows.select("shard", "page_id", "url", "payload", "sha1", "first")

    def run(batches: Iterator[pa.RecordBatch]):
        roller, last, copy = _Roller(uri, roll_bytes), None, 0
        for batch in batches:
            for shard, page, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = payload.encode()
                copy = copy + 1 if (page, sha1) == last else 0
                last = (page, sha1)
                own = len(data) < dedupe_from or first is None or (page == first and not copy)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                roller.add(shard, gzip_member(build_record(page, url, data, digest, None if own else first, copy)))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*roller.done, strict=True)], ["shard", "part", "temporary", "name", "records", "bytes", "sha256"])

    store, root = open_store(uri)
    store.create_dir(f"{root}/_temporary", recursive=True)
    entries = sorted((r.asDict() for r in rows.mapInArrow(run, FILES).collect()), key=lambda e: e["name"])
    if len({e["name"] for e in entries}) != len(entries):
        raise RuntimeError("a shard was written by two tasks")
    if entries:
        rename(pages.sparkSession, uri, entries)
    for e in entries:
        del e["temporary"]
    with store.open_output_stream(f"{root}/_temporary/manifest") as out:
        out.write("".join(json.dumps(e, sort_keys=True) + "\n" for e in entries).encode())
    store.move(f"{root}/_temporary/manifest", f"{root}/manifest.jsonl")
    store.delete_dir(f"{root}/_temporary")
    return entries


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a gzip file, member by member."""
    plain, squeeze, rest = bytearray(), zlib.decompressobj(31), b""

    def fill() -> bool:
        nonlocal squeeze, rest
        if not rest:
            rest = next(data, b"")
            if not rest:
                return False
        plain.extend(squeeze.decompress(rest))
        rest = squeeze.unused_data
        if squeeze.eof:
            squeeze = zlib.decompressobj(31)
        return True

    while True:
        while (end := plain.find(b"\r\n\r\n")) < 0:
            if not fill():
                if plain:
                    raise ValueError("the archive ends within a record")
                return
        version, *lines = bytes(plain[:end]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        stop = end + 4 + int(headers["content-length"])
        while len(plain) < stop + 4:
            if not fill():
                raise ValueError("the archive ends within a record")
        yield headers, bytes(plain[end + 4 : stop])
        del plain[: stop + 4]


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """All records of a committed archive; digests and lengths are verified on the way."""
    store, root = open_store(uri)
    with store.open_input_stream(f"{root}/manifest.jsonl") as f:
        entries = [json.loads(x) for x in f.read().decode().splitlines()]
    if not entries:
        return spark.createDataFrame([], RECORDS)
    names = spark.createDataFrame([(e["name"], e["sha256"]) for e in entries], "name string, sha256 string").repartition(len(entries))

    def run(batches: Iterator[pa.RecordBatch]):
        files, base = open_store(uri)
        for batch in batches:
            for name, sha256 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, rows = hashlib.sha256(), []
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:

                    def blocks(f=f, seen=seen):
                        while block := f.read(1 << 20):
                            seen.update(block)
                            yield block

                    for h, block in parse_records(blocks()):
                        digest, n = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        payload = block.partition(b"\r\n\r\n")[2]
                        if h["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or h["warc-type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                            raise ValueError(f"{name}: damaged record {h['warc-record-id']}")
                        page, refers = (int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page"))
                        rows.append((page, n, digest, h["warc-type"], refers, h["warc-target-uri"], h["warc-record-id"], name))
                        if len(rows) == 5000:
                            yield table_of(rows)
                            rows = []
                if seen.hexdigest() != sha256:
                    raise ValueError(f"{name}: the file isn't the one in the manifest")
                if rows:
                    yield table_of(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def table_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    return names.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, uri: str, **options) -> DataFrame:
    """Write the archives, then the rows of their records as read back.

    Null payloads are empty ones, a null url is ``urn:none``. Rows without an id are
    written too; they refer to the smallest id with their payload, and are responses
    if there is none. Of repeated rows with the smallest id one is the response.
    Other columns are ignored.
    """
    write_archives(pages, uri, **options)
    return read_archives(pages.sparkSession, uri)
