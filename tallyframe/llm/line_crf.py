"""Quality rules by labelling lines with a linear-chain conditional random field.

Every line with a word is content or boilerplate. The field scores a labelling by
weights of line features and by transitions between neighbouring lines; Viterbi
decoding finds the best one, and a document is kept if its content lines hold at
least ``min_share`` of the characters. The plain base rules (too short, or too
repetitive) come first.

Weights are fitted by gradient ascent on the penalised log-likelihood over a
bounded sample of documents with a quality label (``sample_docs`` of each label, in
the order of a hash of the id, until ``sample_lines`` lines; of a document with over
``sample_doc_lines`` lines a run of so many, placed by the hash). Labels are given for
documents, so those of lines are learned: a field without transitions weighs each line
by itself; lines take the label that it finds, but in a good document the likeliest
content lines up to half of the characters are content whatever it finds, and in a bad
one the likeliest boilerplate lines are boilerplate. The field with transitions is
fitted on these labels. Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import SPACE, Chunk, chunks, mix, per_range, prefix_hash, range_hash, sequence_hash, spans, word_hashes

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines long, content_share double, kept boolean"
)
WINDOW = 5


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _table("abcdefghijklmnopqrstuvwxyz")
DIGITS = _table("0123456789")
SHOUT = _table("!?")
STOPS = _table(".!?:;\"')")
CONTINUES = (np.arange(256) & 0xC0) == 0x80
FEATURES = ("bias", "symbols", "upper", "digits", "shout", "up to 3 words", "4 to 10 words", "over 10 words", "equal line", "repeated words", "stop at end", "table bar", "long words", "non-ASCII")


@dataclass
class Lines:
    """Lines with a word, in order; those of document d are ``first[d]:first[d + 1]``."""

    first: np.ndarray
    chars: np.ndarray
    features: np.ndarray


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all \\n-separated lines, blank ones included."""
    breaks = np.flatnonzero(buf == 10)
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
    start = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = off[doc + 1]
    same = doc[1:] == doc[:-1]
    end[:-1][same] = start[1:][same] - 1
    return doc, start, end


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the key occurs again anywhere, the key occurred earlier)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, later


def measure(chunk: Chunk) -> tuple[dict[str, np.ndarray], Lines]:
    """Base counts per document, and its lines with their features."""
    buf, off, n = chunk.buf, chunk.off, len(chunk)
    starts, ends, woff = spans(buf, off)
    words = word_hashes(buf, starts, ends, fold=False)
    word_doc = np.repeat(np.arange(n), np.diff(woff))
    windows = sequence_hash(words, WINDOW)
    repeated = np.zeros(len(words), bool)
    if len(windows):
        inside = np.flatnonzero(word_doc[: len(windows)] == word_doc[WINDOW - 1 :])
        again, _ = repeats(windows[inside] ^ mix(word_doc[inside].astype(np.uint64)))
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, inside[again], 1)
        np.add.at(cover, inside[again] + WINDOW, -1)
        repeated = np.cumsum(cover[:-1]) > 0

    space = SPACE[buf]
    point = ~CONTINUES[buf]
    doc, lo, hi = line_spans(buf, off)
    solid = per_range(point & ~space, lo, hi)
    doc, lo, hi, solid = (x[solid > 0] for x in (doc, lo, hi, solid))
    again, later = repeats(range_hash(prefix_hash(buf, False), lo, hi) ^ mix(doc.astype(np.uint64)))
    base = {
        "n_words": np.diff(woff),
        "word_chars": per_range(point & ~space, off[:-1], off[1:]),
        "n_symbols": per_range(SYMBOLS[buf], off[:-1], off[1:]),
        "n_dup_lines": np.bincount(doc[later], minlength=n),
        "n_repeat_words": per_range(repeated, woff[:-1], woff[1:]),
    }
    a, b = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    n_words = np.maximum(b - a, 1)
    letters = np.maximum(per_range(UPPER[buf] | LOWER[buf], lo, hi), 1)
    share = lambda table: per_range(table[buf], lo, hi) / solid
    last = np.zeros(len(buf) + 1, np.int64)
    np.maximum.accumulate(np.where(space, 0, np.arange(1, len(buf) + 1)), out=last[1:])
    columns = [
        np.ones(len(lo)),
        np.minimum(share(SYMBOLS) * 5, 1),
        per_range(UPPER[buf], lo, hi) / letters,
        share(DIGITS),
        np.minimum(share(SHOUT) * 5, 1),
        n_words <= 3,
        (n_words > 3) & (n_words <= 10),
        n_words > 10,
        again,
        per_range(repeated, a, b) / n_words,
        STOPS[buf[last[hi] - 1]] if len(lo) else np.zeros(0),
        per_range(buf == 124, lo, hi) > 0,
        solid / n_words > 15,
        per_range(buf >= 0xC0, lo, hi) / solid,
    ]
    features = np.stack([np.asarray(c, np.float32) for c in columns], 1) if len(lo) else np.zeros((0, len(FEATURES)), np.float32)
    return base, Lines(np.searchsorted(doc, np.arange(n + 1)), solid, features)


class LineField:
    """A linear-chain field with two labels: 1 is content."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    @staticmethod
    def lockstep(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sequences by falling length, and for each position the lines of those that reach it."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        reach = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
        return order, [first[:-1][order[:k]] + t for t, k in enumerate(reach)]

    def decode(self, lines: Lines) -> np.ndarray:
        """The best label of every line (Viterbi over all documents of a chunk at once)."""
        score = lines.features @ self.weights
        back = np.zeros((len(score), 2), np.int8)
        _, at = self.lockstep(lines.first)
        for t in range(1, len(at)):
            options = score[at[t - 1][: len(at[t])]][:, :, None] + self.steps[None]
            back[at[t]] = options.argmax(1)
            score[at[t]] += options.max(1)
        label = np.zeros(len(score), np.int8)
        for t in range(len(at) - 1, -1, -1):
            label[at[t]] = score[at[t]].argmax(1)
            if t + 1 < len(at):
                n = len(at[t + 1])
                label[at[t][:n]] = back[at[t + 1], label[at[t + 1]]]
        return label

    @classmethod
    def fit(cls, lines: Lines, labels: np.ndarray, rounds: int = 80, penalty: float = 1e-3, rate: float = 0.15) -> LineField:
        """Maximise the penalised log-likelihood; ``labels`` has one label per line."""
        x, n = lines.features.astype(np.float64), max(len(labels), 1)
        _, at = cls.lockstep(lines.first)
        parameters = np.zeros((x.shape[1] + 2, 2))
        slow, fast = np.zeros_like(parameters), np.zeros_like(parameters)
        truth = np.zeros((len(labels), 2))
        truth[np.arange(len(labels)), labels] = 1
        pairs = np.zeros((2, 2))
        for t in range(1, len(at)):
            k = len(at[t])
            np.add.at(pairs, (labels[at[t - 1][:k]], labels[at[t]]), 1)
        for turn in range(1, rounds + 1):
            weights, steps = parameters[:-2], parameters[-2:]
            emit = x @ weights
            emit -= emit.max(1, keepdims=True)
            emit, move = np.exp(emit), np.exp(steps)
            ahead, behind, scale = emit.copy(), np.ones_like(emit), np.ones(len(emit))
            for t, rows in enumerate(at):
                if t:
                    ahead[rows] = (ahead[at[t - 1][: len(rows)]] @ move) * emit[rows]
                scale[rows] = ahead[rows].sum(1)
                ahead[rows] /= scale[rows][:, None]
            expected = np.zeros((2, 2))
            for t in range(len(at) - 1, 0, -1):
                rows, before = at[t], at[t - 1][: len(at[t])]
                message = behind[rows] * emit[rows] / scale[rows][:, None]
                expected += (ahead[before].T @ message) * move
                behind[before] = message @ move.T
            gradient = np.concatenate([x.T @ (truth - ahead * behind), pairs - expected]) / n - penalty * parameters
            slow = 0.9 * slow + 0.1 * gradient
            fast = 0.99 * fast + 0.01 * gradient**2
            parameters = parameters + rate * (slow / (1 - 0.9**turn)) / (np.sqrt(fast / (1 - 0.99**turn)) + 1e-8)
        return cls(parameters[:-2], parameters[-2:])


def line_labels(lines: Lines, quality: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """A label for each line from its evidence (above 0: content), by the labels of the documents.

    The lines that speak most for the document's label take it until they hold half of
    its characters, the others follow their evidence (0: boilerplate).
    """
    doc = np.repeat(np.arange(len(quality)), np.diff(lines.first))
    label = (evidence > 0).astype(np.int64)
    order = np.lexsort((np.where(quality[doc] == 1, -evidence, evidence), doc))
    total = np.concatenate([[0], np.cumsum(lines.chars[order])])
    before = total[:-1] - total[lines.first[doc]]
    bound = np.zeros(len(label), bool)
    bound[order] = 2 * before <= (total[lines.first[1:]] - total[lines.first[:-1]])[doc]
    label[bound] = quality[doc[bound]]
    return label


def fit_documents(lines: Lines, quality: np.ndarray) -> LineField:
    """The field of lines whose documents have the given labels."""
    alone = Lines(np.arange(len(lines.chars) + 1), lines.chars, lines.features)
    weights = LineField.fit(alone, np.repeat(quality, np.diff(lines.first))).weights
    return LineField.fit(lines, line_labels(lines, quality, lines.features @ (weights[:, 1] - weights[:, 0])))


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_docs: int, sample_lines: int, sample_doc_lines: int) -> LineField | None:
    """Fit on a bounded sample; None if one of the labels has no documents."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__q")).where(F.col("__id").isNotNull() & F.col("__q").isin(0, 1))
    picked = None
    for label in (0, 1):
        part = marks.where(F.col("__q") == label).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")

    def run(batches):
        for chunk in chunks(batches):
            _, lines = measure(chunk)
            places = mix(chunk.ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            held, chars = [], []
            for a, b, place in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), places.tolist(), strict=True):
                a += place % (max(b - a - sample_doc_lines, 0) + 1)
                b = min(b, a + sample_doc_lines)
                held.append(lines.features[a:b].tobytes())
                chars.append(lines.chars[a:b].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([chunk.ids, chunk.rows.column(2), pa.array(held, pa.binary()), pa.array(chars, pa.binary())], ["id", "label", "features", "chars"])

    # features of at most 2 * sample_docs documents; only so many lines of them reach the driver
    found = sample.select("__id", "__text", F.col("__q").cast("int")).mapInArrow(run, "id long, label int, features binary, chars binary")
    taken, lines_taken = [], 0
    for row in found.orderBy(F.xxhash64("id"), "id", "label", F.md5("features")).toLocalIterator(prefetchPartitions=False):
        taken.append((row.label, np.frombuffer(bytes(row.features), np.float32).reshape(-1, len(FEATURES)), np.frombuffer(bytes(row.chars), np.int64)))
        lines_taken += len(taken[-1][1])
        if lines_taken >= sample_lines:
            break
    if len({label for label, f, _ in taken if len(f)}) < 2:
        return None
    first = np.concatenate([[0], np.cumsum([len(f) for _, f, _ in taken])])
    lines = Lines(first, np.concatenate([c for _, _, c in taken]), np.concatenate([f for _, f, _ in taken]))
    return fit_documents(lines, np.array([label for label, _, _ in taken], np.int64))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float = 0.5,
    sample_docs: int = 1000,
    sample_lines: int = 60_000,
    sample_doc_lines: int = 6_000,
) -> DataFrame:
    """One row per row of ``docs``: base counts, base_failed, n_lines, content_share and kept.

    A null or empty text has no words: base_failed, share 0, not kept. Null ids and
    repeated rows are rows like others; texts are scored whole at any length. If the labels don't hold both classes, the
    field can't be fitted and every line counts as content. Empty table: no rows.
    """
    field = fit_field(docs, labels, id_col, text_col, sample_docs, sample_lines, sample_doc_lines)
    model = None if field is None else (field.weights, field.steps)

    def run(batches):
        for chunk in chunks(batches):
            base, lines = measure(chunk)
            label = np.ones(len(lines.chars), np.int64) if model is None else LineField(*model).decode(lines)
            every = per_range(lines.chars, lines.first[:-1], lines.first[1:])
            content = per_range(lines.chars * label, lines.first[:-1], lines.first[1:])
            share = content / np.maximum(every, 1)
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            columns = [chunk.ids, *(pa.array(c.astype(np.int64)) for c in base.values())]
            columns += [pa.array(failed), pa.array(np.diff(lines.first).astype(np.int64)), pa.array(share), pa.array(~failed & (share >= min_share))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *base, "base_failed", "n_lines", "content_share", "kept"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
