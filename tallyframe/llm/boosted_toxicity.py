"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities of a fixed lexicon and of two learned ones (whole words, and
word beginnings, which also catch inflected and obfuscated forms), their nearness to
second-person words, capitals, punctuation and obfuscation rates. The learned
lexicons hold words that are over-represented in toxic training documents. So that
trees don't trust a lexicon more than unseen documents justify, features of a
training document come from lexicons learned without its fold, and calibration uses
predictions of trees that didn't see it.

The classifier is fitted on a bounded sample: ``sample_docs`` labelled training
documents of each class, in the order of a hash of the id; calibration weighs them
back to the class shares of all labels. Everything else covers all rows, in one
pass over whole texts without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import ASCII_PUNCTUATION, Chunk, chunks, drop_bytes, per_range, prefix_hash, range_hash, spans, string_bytes, word_hashes

# fixed values: common insults and second-person words of the four languages
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless", "blöd", "dumm", "abschaum", "versager", "crétin", "imbécile", "minable", "ordure", "basura", "estúpido", "imbécil", "inútil", "perdedor")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros")
FOLDS = 3
NEAR = 5
PREFIX_BYTES = 5
FEATURES = ("log words", "lexicon", "lexicon hits", "lexicon top", "beginnings", "beginning hits", "insults", "insult hits", "near second person", "second person", "capitals", "punctuation", "exclamation", "obfuscation")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC3] = True
_INNER = np.zeros(256, bool)
_INNER[list(b"*@$#%0123456789_")] = True


def _hash_words(words) -> np.ndarray:
    buf, off = string_bytes(pa.array(list(words), pa.string()))
    return np.sort(range_hash(prefix_hash(buf, True), off[:-1], off[1:]))


_INSULTS, _SECOND = _hash_words(INSULTS), _hash_words(SECOND_PERSON)


def tokens_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (folded, without ASCII punctuation), hashes of word beginnings, and word offsets."""
    clean = drop_bytes(chunk, ASCII_PUNCTUATION)
    starts, ends, woff = spans(clean.buf, clean.off)
    prefix = prefix_hash(clean.buf, True)
    return range_hash(prefix, starts, ends), range_hash(prefix, starts, np.minimum(ends, starts + PREFIX_BYTES)), woff


def found_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index into the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def top_per_doc(values: np.ndarray, woff: np.ndarray) -> np.ndarray:
    out = np.zeros(len(woff) - 1)
    full = np.flatnonzero(np.diff(woff) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, woff[full])
    return out


def features_of(chunk: Chunk, lexicon: tuple, beginnings: tuple) -> np.ndarray:
    """One row of FEATURES per document; a lexicon is (sorted hashes, weights)."""
    words, heads, woff = tokens_of(chunk)
    a, b = woff[:-1], woff[1:]
    n = np.maximum(np.diff(woff), 1)

    def weights(keys, table):
        at = found_in(keys, table[0])
        return np.where(at >= 0, table[1][at] if len(table[1]) else 0.0, 0.0)

    total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[woff])
    word, head = weights(words, lexicon), weights(heads, beginnings)
    insult, second = found_in(words, _INSULTS) >= 0, found_in(words, _SECOND) >= 0
    hit = (word > 0) | (head > 0) | insult
    doc = np.repeat(np.arange(len(chunk)), np.diff(woff))
    at = np.arange(len(words))
    low, high = np.maximum(at - NEAR, a[doc]), np.minimum(at + NEAR + 1, b[doc])
    near = hit & (per_range(second, low, high) > 0)
    off = chunk.off
    size = np.maximum(np.diff(off), 1)
    letters = np.maximum(per_range(_LETTER[chunk.buf], off[:-1], off[1:]), 1)
    raw_starts, raw_ends, raw_off = spans(chunk.buf, off)
    odd = (per_range(_INNER[chunk.buf], raw_starts + 1, np.maximum(raw_ends - 1, raw_starts + 1)) > 0) & (per_range(_LETTER[chunk.buf], raw_starts, raw_ends) > 0)
    return np.stack(
        [
            np.log1p(np.diff(woff)),
            total(word) / n,
            np.log1p(per_range(word > 0, a, b)),
            top_per_doc(word, woff),
            total(head) / n,
            np.log1p(per_range(head > 0, a, b)),
            per_range(insult, a, b) / n,
            np.log1p(per_range(insult, a, b)),
            np.log1p(per_range(near, a, b)),
            per_range(second, a, b) / n,
            per_range(_UPPER[chunk.buf], off[:-1], off[1:]) / letters,
            per_range(ASCII_PUNCTUATION[chunk.buf], off[:-1], off[1:]) / size,
            per_range(chunk.buf == 33, off[:-1], off[1:]) / size,
            per_range(odd, raw_off[:-1], raw_off[1:]) / n,
        ],
        1,
    )


class BoostedTrees:
    """Complete trees of fixed depth on quantile bins, with logistic loss."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.start, self.trees = start, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        width = x.shape[1]
        flat = binned + np.arange(width) * bins
        mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        start = float(np.log(mean / (1 - mean)))
        raw, trees = np.full(len(y), start), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            slope, curve = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                nodes = 2**level
                key = (node[:, None] * (width * bins) + flat).ravel()
                sums = [np.bincount(key, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2) for v in (slope, curve)]
                g, h = sums
                every_g, every_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + ridge) + (every_g - g) ** 2 / (every_h - h + ridge) - every_g**2 / (every_h + ridge)
                for f, c in enumerate(cuts):
                    gain[:, f, len(c) :] = -1
                gain[(h < 1e-3) | (every_h - h < 1e-3)] = -1
                best = gain.reshape(nodes, -1).argmax(1)
                right = np.zeros(len(y), bool)
                for k in range(nodes):
                    f, at = divmod(int(best[k]), bins)
                    if gain[k, f, at] > 1e-9:
                        feature[nodes - 1 + k], limit[nodes - 1 + k] = f, cuts[f][at]
                        right |= (node == k) & (binned[:, f] > at)
                node = 2 * node + right
            leaves = rate * np.bincount(node, slope, 2**depth) / (np.bincount(node, curve, 2**depth) + ridge)
            raw = raw + leaves[node]
            trees.append((feature, limit, leaves))
        return cls(start, trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaves).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            raw += leaves[node - (len(leaves) - 1)]
        return raw


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw score, calibrated probability), both rising."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, t, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([w * t, w, r, r])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    knots = [(r, s / n) for s, n, low, high in blocks for r in ([low, high] if high > low else [low])]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def id_crc(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def _lexicons(counts: list, docs_by: np.ndarray, without: int | None, least: int, odds: float) -> list[tuple]:
    """Sorted hashes and log-odds weights per kind, leaving out one fold."""
    folds = [f for f in range(FOLDS) if f != without]
    toxic, clean = (max(1, sum(docs_by[c, f] for f in folds)) for c in (1, 0))
    out: list[tuple] = []
    for kind in (0, 1):
        rows = [r for r in counts if r[0] == kind]
        h = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        p = np.array([sum(r[2 + f] for f in folds) for r in rows], float)
        q = np.array([sum(r[2 + FOLDS + f] for f in folds) for r in rows], float)
        w = np.log((p + 0.5) / toxic) - np.log((q + 0.5) / clean)
        keep = (p >= least) & (w >= odds)
        order = np.argsort(h[keep])
        out.append((h[keep][order], w[keep][order]))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_docs: int, least: int, odds: float, lexicon_size: int):
    """(lexicons, trees, knots); trees and knots are None if the sample doesn't hold both classes."""
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__y"))
    marks = marks.where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (id_crc("__id") % 4 != 2))
    share = {r[0]: r[1] for r in marks.groupBy("__y").count().collect()}
    picked = None
    for label in (0, 1):
        part = marks.where(F.col("__y") == label).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    sample = sample.select("__id", "__text", "__y", F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("__fold"))

    def words(batches):
        """Documents of each class and fold that hold a word or beginning; kind 2 counts documents."""
        for chunk in chunks(batches):
            words, heads, woff = tokens_of(chunk)
            group = chunk.rows.column(2).to_numpy() * FOLDS + chunk.rows.column(3).to_numpy()
            doc = np.repeat(np.arange(len(chunk)), np.diff(woff))
            for kind, keys in ((0, words), (1, heads)):
                order = np.lexsort((keys, doc))
                k, d = keys[order], doc[order]
                fresh = np.ones(len(k), bool)
                fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                distinct, inverse = np.unique(k[fresh], return_inverse=True)
                table = np.zeros((len(distinct), 2 * FOLDS), np.int64)
                np.add.at(table, (inverse, group[d[fresh]]), 1)
                yield rows_of(kind, distinct, table)
            table = np.bincount(group, minlength=2 * FOLDS)[None]
            yield rows_of(2, np.zeros(1, np.uint64), table)

    names = [f"{c}{f}" for c in ("n", "p") for f in range(FOLDS)]

    def rows_of(kind, keys, table):
        columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(c, np.int64)) for c in table.T)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "hash", *names])

    counts = sample.mapInArrow(words, "kind int, hash long, " + ", ".join(f"{n} long" for n in names)).groupBy("kind", "hash").agg(*[F.sum(n).alias(n) for n in names])
    positive = sum(F.col(f"p{f}") for f in range(FOLDS))
    negative = sum(F.col(f"n{f}") for f in range(FOLDS))
    sampled = {c: max(1, min(sample_docs, share.get(c, 0))) for c in (0, 1)}
    wanted = (F.col("kind") == 2) | ((positive >= least) & (positive / sampled[1] > negative / sampled[0]))
    got = counts.where(wanted).orderBy((F.col("kind") != 2).cast("int"), (positive / sampled[1] - negative / sampled[0]).desc(), "kind", "hash").limit(lexicon_size + 1)
    got = [(r["kind"], r["hash"], *(r[f"p{f}"] for f in range(FOLDS)), *(r[f"n{f}"] for f in range(FOLDS))) for r in got.collect()]
    docs_by = np.zeros((2, FOLDS))
    for r in got:
        if r[0] == 2:
            docs_by[1], docs_by[0] = r[2 : 2 + FOLDS], r[2 + FOLDS :]
    got = [r for r in got if r[0] != 2]
    by_fold = [_lexicons(got, docs_by, f, least, odds) for f in range(FOLDS)]
    final = _lexicons(got, docs_by, None, least, odds)

    def measure(batches):
        for chunk in chunks(batches):
            fold = chunk.rows.column(3).to_numpy()
            x = np.zeros((len(chunk), len(FEATURES)))
            for f in range(FOLDS):
                if (fold == f).any():
                    x[fold == f] = features_of(chunk, *by_fold[f])[fold == f]
            yield pa.RecordBatch.from_arrays([chunk.ids, chunk.rows.column(2), chunk.rows.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "fold", "x"])

    rows = sorted(((r.id, r.y, r.fold, bytes(r.x)) for r in sample.mapInArrow(measure, "id long, y int, fold int, x binary").toLocalIterator()))
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return final, None, None
    x = np.array([np.frombuffer(r[3]) for r in rows])
    fold = np.array([r[2] for r in rows])
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    weight = weight / weight.mean()
    apart = np.zeros(len(y))
    for f in range(FOLDS):
        seen = fold != f
        if seen.all() or len(set(y[seen].tolist())) < 2:
            apart[~seen] = np.log(weight[y == 1].sum() / weight[y == 0].sum())
        else:
            apart[~seen] = BoostedTrees.fit(x[seen], y[seen], weight[seen]).predict(x[~seen])
    return final, BoostedTrees.fit(x, y, weight), isotonic(apart, y, weight)


def scorer(fitted):
    """A function of a chunk: calibrated scores."""
    lexicons, trees, knots = fitted
    model = None if trees is None else (trees.start, trees.trees)
    return lambda chunk: np.zeros(len(chunk)) if model is None else np.interp(BoostedTrees(*model).predict(features_of(chunk, *lexicons)), *knots)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    sample_docs: int = 6000,
    least: int = 3,
    odds: float = 1.5,
    lexicon_size: int = 20_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (score >= threshold).

    Labels are learned only from ids whose crc32 (of the id as text) modulo 4 isn't
    2; held_out marks the others (false for a null id). Null and empty texts are
    scored like documents without words. Repeated rows are scored alike; labels of
    unknown documents or other values are ignored. Without both classes in the
    sample every score is 0. An empty table gives no rows.
    """
    score_chunk = scorer(fit(docs, labels, id_col, text_col, sample_docs, least, odds, lexicon_size))

    def run(batches):
        for chunk in chunks(batches):
            score = score_chunk(chunk)
            yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    sample_docs: int = 6000,
    least: int = 3,
    odds: float = 1.5,
    lexicon_size: int = 20_000,
) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; nothing is shuffled."""
    score_chunk = scorer(fit(docs, labels, id_col, text_col, sample_docs, least, odds, lexicon_size))
    columns = docs.columns
    rows = docs.select(id_col, text_col, *(c for c in columns if c not in (id_col, text_col)))

    def run(batches):
        for chunk in chunks(batches):
            yield chunk.rows.filter(pa.array(score_chunk(chunk) < threshold))

    return rows.mapInArrow(run, rows.schema).select(*columns)
