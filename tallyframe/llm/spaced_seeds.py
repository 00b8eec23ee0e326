"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of tokens; positions marked 0 are ignored, so
that a substituted token there doesn't hide the match. All seeds of the benchmark
are hashed into a sorted table, each position of each document is hashed under
each mask, and equal hashes are hits. A hit fixes an alignment of the item against
the document; the tokens along it are compared and the best segment (match +1,
substitution -2) is the overlap. A document is contaminated by an item if the
overlap has at least ``min_match`` equal tokens (all but a fifth, for items that
are shorter) and its substitutions are at most a fifth of it.

The benchmark is the stated query set. It is taken in blocks of at most
``block_bytes`` of text; each block is broadcast and compared with all documents.
Documents aren't shuffled and none is compared with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import ASCII_PUNCTUATION, Chunk, chunks, drop_bytes, mix, spans, string_bytes, word_hashes

MASKS = ("1111011", "11001000111", "11010100011", "111111")
MIDDLE_MASKS = ("111011", "11010011", "11111")
HITS = 1 << 20
SCHEMA = "doc_id long, item_id long, n_match long, n_overlap long, doc_word long, item_words long"


def seed_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash at each position over the tokens that the mask marks 1."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0xC2B2AE3D27D4EB4F)
            out += words[i : i + n]
    return mix(out)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n tokens."""
    if n >= 15:
        return MASKS
    if n >= 10:
        return MIDDLE_MASKS
    if n < 5:
        return ("1" * n,) if n else ()
    return ("1" * (n - 1), *("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)))


class SeedIndex:
    """Seeds of some items: sorted hashes with (item, position), and a bit table that rejects most lookups."""

    def __init__(self, ids: list, texts: list):
        buf, off = string_bytes(pa.array(texts, pa.string()))
        chunk = drop_bytes(Chunk(pa.array(ids, pa.int64()), buf, off), ASCII_PUNCTUATION)
        starts, ends, woff = spans(chunk.buf, chunk.off)
        words = word_hashes(chunk.buf, starts, ends)
        self.ids, self.items = ids, [words[a:b] for a, b in zip(woff[:-1], woff[1:], strict=True)]
        self.masks = list(dict.fromkeys(mask for n in sorted({len(x) for x in self.items}) for mask in masks_of(n)))
        found = [[] for _ in range(3)]
        for i, item in enumerate(self.items):
            for mask in masks_of(len(item)):
                h = seed_hashes(item, mask, self.masks.index(mask))
                for out, x in zip(found, (h, np.full(len(h), i), np.arange(len(h))), strict=True):
                    out.append(x)
        self.hash, self.item, self.at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.uint64, np.int64, np.int64), strict=True))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]
        # four times as many places as seeds, 2**20 to 2**26
        self.shift = np.uint64(64 - min(max(20, (4 * len(self.hash)).bit_length()), 26))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.hash >> self.shift] = True

    def alignments(self, words: np.ndarray, woff: np.ndarray, hits: int = HITS) -> Iterator[np.ndarray]:
        """Distinct (document, item, offset of the item's start in the document's words), by runs of words with about ``hits`` hits."""
        found, load = [], np.zeros(len(words), np.int64)
        for m, mask in enumerate(self.masks):
            h = seed_hashes(words, mask, m)
            at = np.flatnonzero(self.bits[h >> self.shift])
            first, last = (np.searchsorted(self.hash, h[at], side) for side in ("left", "right"))
            hit = last > first
            at, first, n = at[hit], first[hit], (last - first)[hit]
            inside = at + len(mask) <= woff[np.searchsorted(woff, at, "right")]
            found.append((at[inside], first[inside], n[inside]))
            load[at[inside]] += n[inside]
        run = np.cumsum(load) // hits
        for k in np.unique(run[load > 0]):
            low, high = np.searchsorted(run, k, "left"), np.searchsorted(run, k, "right")
            out = []
            for every, firsts, counts in found:
                a, b = np.searchsorted(every, (low, high))
                at, first, n = every[a:b], firsts[a:b], counts[a:b]
                seed = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = np.repeat(at, n)
                out.append(np.stack([np.searchsorted(woff, at, "right") - 1, self.item[seed], at - self.at[seed]], 1))
            yield np.unique(np.concatenate(out), axis=0)


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the segment with the highest sum of +1 per match and -2 per substitution."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    start = int(np.argmin(gain[: end + 1]))
    return start, end, int(equal[start:end].sum())


def find_overlaps(index: SeedIndex, chunk: Chunk, min_match: int, max_substituted: float) -> list[tuple]:
    clean = drop_bytes(chunk, ASCII_PUNCTUATION)
    starts, ends, woff = spans(clean.buf, clean.off)
    words = word_hashes(clean.buf, starts, ends)
    best: dict[tuple[int, int], tuple] = {}
    for doc, item, start in (row for run in index.alignments(words, woff) for row in run.tolist()):
        tokens = index.items[item]
        low, high = max(start, int(woff[doc])), min(start + len(tokens), int(woff[doc + 1]))
        a, b, match = best_segment(words[low:high] == tokens[low - start : high - start])
        need = min(min_match, -(-4 * len(tokens) // 5))
        if match >= need and (b - a - match) <= max_substituted * (b - a):
            found = (match, b - a, low + a - int(woff[doc]), len(tokens))
            if found > best.get((doc, item), ()):
                best[doc, item] = found
    return [(chunk.ids[d].as_py(), index.ids[i], *x) for (d, i), x in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of at most about ``block_bytes``; one block is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if got:
            yield [r[0] for r in got], [r[1] for r in got]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 12,
    max_substituted: float = 0.2,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, n_match, n_overlap, doc_word, item_words.

    Tokens are lower-cased (A-Z) words without ASCII punctuation. Documents or items
    that are null or have no words overlap with nothing; a null id stays null in the
    result; repeated rows each give their own result row. Of several alignments of the
    same pair the one with most matches is reported. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    out = None
    for ids, texts in benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches, shared=shared):
            index = SeedIndex(*shared.value)
            for chunk in chunks(batches):
                found = find_overlaps(index, chunk, min_match, max_substituted)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "n_match", "n_overlap", "doc_word", "item_words"])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 12,
    max_substituted: float = 0.2,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows of ``docs`` that no benchmark item overlaps with, with all their columns; nothing is shuffled."""
    columns = docs.columns
    order = [id_col, text_col, *(c for c in columns if c not in (id_col, text_col))]
    out = docs.select(*order)
    schema = out.schema
    for ids, texts in benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches, shared=shared):
            index = SeedIndex(*shared.value)
            for chunk in chunks(batches):
                numbered = Chunk(pa.array(range(len(chunk))), chunk.buf, chunk.off)
                clean = np.ones(len(chunk), bool)
                clean[[row[0] for row in find_overlaps(index, numbered, min_match, max_substituted)]] = False
                yield chunk.rows.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
    return out.select(*columns)
