"""Vectorised word handling over Arrow batches of documents.

Documents arrive in ``mapInArrow`` batches and are cut into chunks of a few
megabytes, so that the numpy temporaries stay bounded whatever the batch size
(one document that is longer than a chunk is a chunk of its own). White space
is ASCII only (``\\x20 \\x09-\\x0D``), hence words can be found on UTF-8 bytes.

Word and shingle identities are 64-bit hashes. Two given documents of a
thousand words disagree with an exact comparison with a probability below
1e-12, at any size of the corpus, since only pairs are ever compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Chunk:
    """``ids`` is an Arrow array (nulls allowed); document d is ``buf[off[d]:off[d + 1]]``; ``rows`` has all columns."""

    ids: pa.Array
    buf: np.ndarray
    off: np.ndarray
    rows: pa.RecordBatch | None = None

    def __len__(self) -> int:
        return len(self.ids)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches (first column: id, second: text) into chunks of about ``size`` bytes."""
    for batch in batches:
        buf, off = string_bytes(batch.column(1))
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(off, off[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), n)
            rows = batch.slice(start, stop - start)
            yield Chunk(rows.column(0), buf[off[start] : off[stop]], off[start : stop + 1] - off[start], rows)
            start = stop


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:  # the table of one very long text is not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words; ``woff[d]`` is the first word of document d."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    edge = np.ones(n + 1, bool)  # a document's border always separates
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    edge[off] = True
    at = np.flatnonzero(edge)
    starts = at[:-1]
    inside = word[starts]
    return starts[inside], at[1:][inside], np.searchsorted(starts[inside], off)


def prefix_hash(buf: np.ndarray, fold: bool) -> np.ndarray:
    """H with H[j] - H[i] = sum of value(b) * base**position over bytes i..j-1."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUE)[buf] * powers(len(buf)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal for equal content anywhere."""
    inverse = powers(len(prefix), _INVERSE)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of every word; ``fold`` lower-cases A-Z and nothing else."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return range_hash(prefix_hash(buf, fold), starts, ends)


_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def sequence_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (in order); windows may cross documents, callers slice."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += words[i : n + i]
    return mix(out ^ np.uint64(k))


def drop_bytes(chunk: Chunk, dropped: np.ndarray) -> Chunk:
    """The chunk without the bytes for which the 256-entry table is true."""
    keep = ~dropped[chunk.buf]
    kept = np.zeros(len(chunk.buf) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return Chunk(chunk.ids, chunk.buf[keep], kept[chunk.off], chunk.rows)


def per_range(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


ASCII_PUNCTUATION = np.zeros(256, bool)
ASCII_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
