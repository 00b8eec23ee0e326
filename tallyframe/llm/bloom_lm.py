"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of all training documents are gathered as sorted
key blobs (one shuffle; each task sends its own counts, combined). A count c is
quantised to q = 1 + floor(log_b c), and the pairs (n-gram, 1) .. (n-gram, q) enter a
Bloom filter. The count of an n-gram is found by probing 1, 2, ... until the first miss; the model interpolates the pair's and the word's estimates:

    P(w | u) = share * c(u w) / c(u) + (1 - share) * (c(w) + 0.5) / (N + 0.5 (V + 1))

and P(w | u) is the word's part alone where u or the pair isn't in the filter. The
filter has ``bits_per_item`` bits for each item and one part for each bucket of keys,
so it grows with the corpus and holds every count. Up to ``filter_bytes`` it is
broadcast. Beyond, the texts become units of word numbers, the distinct keys of each
unit are sent to the parts of the filter and their levels are sent back; the bits that
are probed, and so the scores, are the same either way.

The base score needs exact counts. Words at or above a count that leaves at most
``table_words`` of them are broadcast; the remaining occurrences of each document are
joined with the count table by a shuffle, so that the vocabulary may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import cut
from tallyframe.llm.text import Chunk, chunks, mix, spans, word_hashes

BASE = 1.5
LEVELS = 64
PROBES = 5
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
FLUSH_KEYS = 3_000_000
UNIT_TOKENS = 500_000
PROBE_KEYS = 500_000
PAIR_BYTES = 5


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and one end per document, of what stands before each, and document offsets."""
    starts, ends, woff = spans(chunk.buf, chunk.off)
    words = word_hashes(chunk.buf, starts, ends)
    n = len(chunk)
    off = woff + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    out[off[1:] - 1] = END
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(woff))] = words
    return out, preceding(out, off), off


def preceding(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """What stands before each word or end."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[off[:-1]] = BEGIN
    return before


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _STEP + word)


def quantise(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def _values() -> np.ndarray:
    """The mean of the counts that share a level; 0 for level 0."""
    out = [0.0]
    for q in range(1, LEVELS):
        low, high = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


VALUES = _values()


def combine(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte per count; counts from 255 follow as 64-bit numbers."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, offset=n) if len(data) > n else 255
    return counts


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each key."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def short_pair(keys: np.ndarray, bits: int) -> np.ndarray:
    """A pair's identity: its bucket (the ``bits`` high bits) and the 40 bits below."""
    return (keys << np.uint64(bits)) >> np.uint64(64 - 8 * PAIR_BYTES) if bits else keys >> np.uint64(64 - 8 * PAIR_BYTES)


BLOB = "kind int, bucket int, n long, keys binary, counts binary"
MERGED = "kind int, bucket int, total long, n long, levels array<long>, keys binary, counts binary"


def count_blobs(train: DataFrame, bits: int) -> DataFrame:
    """Each task's combined counts of words (kind 1) and pairs (kind 2), cut by the high bits of the key."""

    def run(batches):
        held: dict[int, list] = {1: [], 2: []}
        size = 0
        for chunk in chunks(batches):
            word, before, _ = tokens(chunk)
            for kind, keys in ((1, word), (2, pair_hash(before, word))):
                held[kind].append(combine(keys))
                size += len(held[kind][-1][0])
            if size > FLUSH_KEYS:
                yield from flush(held)
                held, size = {1: [], 2: []}, 0
        yield from flush(held)

    def flush(held):
        for kind, parts in held.items():
            if not parts:
                continue
            keys, counts = combine(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            edges = cut_at(keys, bits).tolist()
            rows = []
            for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if j > i:
                    data = pack_keys(keys[i:j], 8) if kind == 1 else pack_keys(short_pair(keys[i:j], bits), PAIR_BYTES)
                    rows.append((kind, b, j - i, data, pack_counts(counts[i:j])))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "n", "keys", "counts"])

    return train.mapInArrow(run, BLOB)


def merge_blobs(blobs: DataFrame, pair_least: int) -> DataFrame:
    """Counts over all tasks: one row per kind and bucket; pairs below ``pair_least`` are counted but not listed."""

    def merge(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        width = 8 if kind == 1 else PAIR_BYTES
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts, size = [], 0
        for n, k, c in zip(group["n"].to_pylist(), group["keys"], group["counts"], strict=True):
            parts.append((unpack_keys(k.as_buffer(), width), unpack_counts(c.as_buffer(), n)))
            size += n
            if size > FLUSH_KEYS:
                keys, counts = combine(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([counts, *(p[1] for p in parts)]))
                parts, size = [], 0
        keys, counts = combine(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([counts, *(p[1] for p in parts)]))
        total, distinct = int(counts.sum()), len(keys)
        if kind == 2:
            keys, counts = keys[counts >= pair_least], counts[counts >= pair_least]
        levels = np.bincount(quantise(counts), minlength=LEVELS).tolist() if len(counts) else [0] * LEVELS
        row = [[kind], [bucket], [total], [distinct], [levels], [pack_keys(keys, width)], [pack_counts(counts)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in MERGED.split(", ")])

    return blobs.groupBy("kind", "bucket").applyInArrow(merge, MERGED)


class LogFilter:
    """Bit arrays per kind and bucket; holds (key, level) for level 1 .. q."""

    def __init__(self, parts: dict[tuple[int, int], bytes], bits: int, first: int):
        self.bits, self.first = bits, first
        self.sizes, self.starts, blocks, at = {}, {}, [], 0
        for kind in (1, 2):
            size, start = np.ones(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
            for b in range(1 << bits):
                data = parts.get((kind, b), b"\0")
                size[b], start[b] = len(data) * 8, at
                blocks.append(data)
                at += len(data) * 8
            self.sizes[kind], self.starts[kind] = size, start
        self.data = np.frombuffer(b"".join(blocks), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """PROBES hash values of (key, level), one array after another."""
        h = mix(keys * np.uint64(0x9FB21C651E98DF25) + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        step = mix(h) | np.uint64(1)
        for _ in range(PROBES):
            yield h
            h = h + step

    @classmethod
    def build(cls, keys: np.ndarray, levels: np.ndarray, first: int, bits_per_item: int) -> bytes:
        """The bits of one bucket: items are levels ``first`` .. q of each key that reaches ``first``."""
        keep = levels >= first
        keys, levels = keys[keep], levels[keep]
        n = int((levels - first + 1).sum())
        size = max(1, -(-n * bits_per_item // 8))
        out = np.zeros(size * 8, bool)
        for level in range(first, int(levels.max(initial=0)) + 1):
            for h in cls.places(keys[levels >= level], level):
                out[h % np.uint64(size * 8)] = True
        return np.packbits(out, bitorder="little").tobytes()

    def level(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The highest level reached by probing until the first miss (0: not stored)."""
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        size, start = self.sizes[kind][bucket], self.starts[kind][bucket]
        own = keys if kind == 1 else short_pair(keys, self.bits)
        out, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(self.first, LEVELS):
            hit = np.ones(len(alive), bool)
            rest = np.arange(len(alive))
            k, m, s = own[alive], size[alive], start[alive]
            h = mix(k * np.uint64(0x9FB21C651E98DF25) + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            step = mix(h) | np.uint64(1)
            for _ in range(PROBES):
                at = s[rest] + (h[rest] % m[rest]).astype(np.int64)
                found = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                hit[rest[~found]] = False
                rest = rest[found]
                h = h + step
            alive = alive[hit]
            out[alive] = level
            if not len(alive):
                break
        return out


def cut_at(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of the sorted keys begins, and the end of the last."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    return np.concatenate([[0], edges, [len(keys)]]).astype(np.int64)


def binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """A binary column whose value i is ``data[ends[i]:ends[i + 1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def text_units(rows: DataFrame) -> DataFrame:
    """The texts in units of about ``UNIT_TOKENS`` tokens: ids, ends of the documents, distinct words in order and the number of each word."""

    def run(batches):
        held, size = [], 0
        for chunk in chunks(batches):
            word, _, off = tokens(chunk)
            held.append((chunk.ids, word, np.diff(off)))
            size += len(word)
            if size >= UNIT_TOKENS:
                yield unit(held)
                held, size = [], 0
        if held:
            yield unit(held)

    def unit(held):
        words, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        ids = pa.concat_arrays([h[0] for h in held])
        off = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))]).astype(np.int64)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in (off, words, at.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "off", "words", "at"])

    units = rows.select("doc_id", "text").mapInArrow(run, "ids array<long>, off binary, words binary, at binary")
    return cut(units.withColumn("unit", F.monotonically_increasing_id()))


def read_unit(off: pa.Scalar, words: pa.Scalar, at: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, what stands before each, document offsets and distinct words of a unit."""
    off, words, at = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((off, np.int64), (words, np.uint64), (at, np.int32)))
    word = words[at]
    return word, preceding(word, off), off, words


def unit_levels(units: DataFrame, parts: DataFrame, bits: int) -> DataFrame:
    """(unit, kind, bucket, levels) of the distinct words and pairs of each unit, probed where the bucket's part of the filter is."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                word, before, _, words = read_unit(*(batch.column(c)[i] for c in (1, 2, 3)))
                for kind, keys in ((1, words), (2, np.unique(pair_hash(before, word)))):
                    width = 8 if kind == 1 else PAIR_BYTES
                    ends = cut_at(keys, bits)
                    used = np.flatnonzero(np.diff(ends))
                    data = pack_keys(keys if kind == 1 else short_pair(keys, bits), width)
                    columns = [np.full(len(used), batch.column(0)[i].as_py(), np.int64), np.full(len(used), kind, np.int32), used.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binaries(data, np.append(ends[:-1][used], len(keys)) * width)], ["unit", "kind", "bucket", "keys"])

    def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
        if asked.num_rows:
            width = 8 if asked["kind"][0].as_py() == 1 else PAIR_BYTES
            stored = LogFilter({(1, 0): part["data"][0].as_py()} if part.num_rows else {}, 0, 1)
            sent = [k.as_buffer() for k in asked["keys"]]
            keys = unpack_keys(b"".join(sent), width)
            found = [stored.level(1, keys[i : i + PROBE_KEYS]).astype(np.uint8) for i in range(0, len(keys), PROBE_KEYS)]
            levels = binaries(np.concatenate(found).tobytes(), np.concatenate([[0], np.cumsum([k.size // width for k in sent])]))
        else:
            levels = pa.array([], pa.binary())
        return pa.table([asked["unit"], asked["kind"], asked["bucket"], levels], names=["unit", "kind", "bucket", "levels"])

    asked = units.select("unit", "off", "words", "at").mapInArrow(ask, "unit long, kind int, bucket int, keys binary")
    key = ["kind", "bucket"]
    return asked.groupBy(*key).cogroup(parts.groupBy(*key)).applyInArrow(answer, "unit long, kind int, bucket int, levels binary")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = 0.1,
    pair_least: int = 1,
    bits_per_item: int = 10,
    filter_bytes: int = 128 << 20,
    table_words: int = 4_000_000,
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32 (of the id as text) modulo 5 isn't 1; a
    null id trains. A null text is empty and consists of its end. Repeated rows are
    counted as often as they occur. Without training documents nothing is known:
    N = V = 0 and every token has the probability 1. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    train = rows.where(~held_out("doc_id"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, min(24, int(math.ceil(math.log2(max(1, size / bucket_bytes))))))
    merged = cut(merge_blobs(count_blobs(train, bits), pair_least))

    facts = merged.select("kind", "total", "n", "levels").collect()
    total, distinct = sum(r.total for r in facts if r.kind == 1), sum(r.n for r in facts if r.kind == 1)
    levels = np.sum([r.levels for r in facts], 0) if facts else np.zeros(LEVELS, np.int64)
    reached = levels[::-1].cumsum()[::-1]  # keys that have at least this level
    whole = int(reached[1:].sum()) * bits_per_item <= 8 * filter_bytes

    def build(batches):
        for batch in batches:
            data = []
            for kind, n, keys, counts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), batch.column(4), strict=True):
                k = unpack_keys(keys.as_buffer(), 8 if kind == 1 else PAIR_BYTES)
                c = unpack_counts(counts.as_buffer(), len(k))
                data.append(LogFilter.build(k, quantise(c) if len(c) else np.zeros(0, np.int64), 1, bits_per_item))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["kind", "bucket", "data"])

    parts = merged.select("kind", "bucket", "n", "keys", "counts").mapInArrow(build, "kind int, bucket int, data binary")
    stored = LogFilter({(r.kind, r.bucket): bytes(r.data) for r in parts.toLocalIterator()}, bits, 1) if whole else None

    # the exact counts that are broadcast: all words from `least` on, at most table_words of them
    words = merged.where("kind = 1").select("n", "keys", "counts")
    by_level = np.sum([r.levels for r in facts if r.kind == 1], 0) if facts else np.zeros(LEVELS, np.int64)
    from_level = by_level[::-1].cumsum()[::-1]
    lowest = next((q for q in range(1, LEVELS) if from_level[q] <= table_words), LEVELS)
    complete = lowest == 1

    def listed(above: bool):
        def run(batches):
            for batch in batches:
                for keys, counts in zip(batch.column(1), batch.column(2), strict=True):
                    k = unpack_keys(keys.as_buffer(), 8)
                    c = unpack_counts(counts.as_buffer(), len(k))
                    keep = (quantise(c) >= lowest) == above
                    if above:
                        yield pa.RecordBatch.from_arrays([pa.array([k[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], ["k", "c"])
                    else:
                        for at in range(0, int(keep.sum()), 100_000):
                            part = slice(at, at + 100_000)
                            yield pa.RecordBatch.from_arrays([pa.array(k[keep][part].view(np.int64)), pa.array(c[keep][part])], ["hash", "c"])

        return run

    table = [(np.frombuffer(bytes(r.k), np.uint64), np.frombuffer(bytes(r.c), np.int64)) for r in words.mapInArrow(listed(True), "k binary, c binary").toLocalIterator()]
    keys = np.concatenate([t[0] for t in table]) if table else np.zeros(0, np.uint64)
    counts = np.concatenate([t[1] for t in table]) if table else np.zeros(0, np.int64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((stored, keys[order], np.minimum(counts[order], 2**63 - 1)))
    del table, keys, counts, order, stored
    rest = total + 0.5 * (distinct + 1)

    def estimate(ids: pa.Array, word: np.ndarray, before: np.ndarray, off: np.ndarray, level_of) -> pa.RecordBatch:
        _, known, count = shared.value
        distinct_words, at = np.unique(word, return_inverse=True)
        level = level_of(1, distinct_words)
        single = (VALUES[level] + 0.5) / rest
        place = np.minimum(np.searchsorted(known, distinct_words), max(len(known) - 1, 0))
        hit = known[place] == distinct_words if len(known) else np.zeros(len(distinct_words), bool)
        exact = np.where(hit, count[place], 0) if len(known) else np.zeros(len(distinct_words), np.int64)
        cold = ~hit & (not complete)
        logs = np.where(cold, 0.0, np.log10((exact + 0.5) / rest))

        distinct_before, before_at = np.unique(before, return_inverse=True)
        # a document's begin is as frequent as its end
        context = VALUES[level_of(1, np.where(distinct_before == BEGIN, END, distinct_before))][before_at]
        pairs, pair_at = np.unique(pair_hash(before, word), return_inverse=True)
        pair = VALUES[level_of(2, pairs)][pair_at]
        p = single[at]
        both = (context > 0) & (pair > 0)
        p = np.where(both, share * np.minimum(pair / np.maximum(context, 1), 1) + (1 - share) * p, p)
        total_of = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[off])
        is_cold = cold[at]
        cold_words = word[is_cold].view(np.int64)
        cold_off = np.concatenate([[0], np.cumsum(is_cold)])[off].astype(np.int32)
        columns = [
            ids,
            pa.array(np.diff(off).astype(np.int64)),
            pa.array(total_of(exact[at] > 0).astype(np.int64)),
            pa.array(np.add.reduceat(logs[at], off[:-1])),
            pa.array(np.add.reduceat(np.log10(p), off[:-1])),
            pa.ListArray.from_arrays(pa.array(cold_off), pa.array(cold_words)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score", "cold"])

    def run(batches):
        for chunk in chunks(batches):
            yield estimate(chunk.ids, *tokens(chunk), shared.value[0].level)

    def run_unit(unit: pa.Table, found: pa.Table) -> pa.Table:
        word, before, off, words = read_unit(*(unit[c][0] for c in ("off", "words", "at")))
        keys = {1: words, 2: np.unique(pair_hash(before, word))}
        found = found.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        levels = np.frombuffer(b"".join(x.as_buffer() for x in found["levels"]), np.uint8)
        levels = {1: levels[: len(words)], 2: levels[len(words) :]}
        ids = unit["ids"].combine_chunks().flatten()
        return pa.Table.from_batches([estimate(ids, word, before, off, lambda kind, k: levels[kind][np.searchsorted(keys[kind], k)])])

    columns = "doc_id long, n_tokens long, n_known long, base_score double, score double, cold array<long>"
    if whole:
        scored = rows.mapInArrow(run, columns)
    else:
        units = text_units(rows)
        scored = units.groupBy("unit").cogroup(unit_levels(units, parts, bits).groupBy("unit")).applyInArrow(run_unit, columns)
    if not complete:
        scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
        few = words.mapInArrow(listed(False), "hash long, c long")
        cold = scored.select("row", F.explode("cold").alias("hash")).groupBy("row", "hash").agg(F.count(F.lit(1)).alias("n"))
        cold = cold.join(few, "hash", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
        cold = cold.groupBy("row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(rest))).alias("more_score"),
        )
        scored = scored.join(cold, "row", "left")
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more_score", F.lit(0.0)))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
