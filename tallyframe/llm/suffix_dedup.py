"""Removal of repeated byte strings by a suffix order built with deep-shallow sorting.

Every byte covered by a ``length``-byte string that starts at another place as well
(in any document) is removed. Only suffixes at *anchors* are sorted: an anchor is the
position of the smallest hash of a ``gram``-byte string in some ``length``-byte window.
Equal windows have their anchors at the same offset with equal grams, so every
repeat shows up as anchors with equal gram hashes, about one in 70 positions.

For the anchors of one hash, the text after the anchor and the reversed text before
it are sorted as suffixes: multikey quicksort on 8-byte characters down to a shallow
depth, then a blind trie for each group that is still equal there. The common
prefixes of neighbours in both orders tell which windows around an anchor are equal
in full, and the widest of them bound the removed bytes. All comparisons are on the
bytes; hashes only bring candidates together.

A gram that occurs very often is mostly surrounded by the same bytes (copies, passages,
runs of one period). Beyond ``hot_rows`` anchors, equal surroundings become a class,
combined before the shuffle: what occurs twice is repeated in full, and one of each class
is sorted like any other group. Classes of one gram that are themselves more than
``hot_rows`` can't be sorted in one task; their windows are counted by a 128-bit hash.
The rows that come out are the same whichever way a group takes.

Shuffles: anchors by hash (about 0.4 bytes per byte of text; those of frequent grams are
dealt by place), the texts once by document (used both to cut out contexts and to apply
the removals), and the contexts of anchors whose hash occurs twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.prefilter import bit_table, with_possible
from tallyframe.llm.store import cut
from tallyframe.llm.text import chunks, mix, prefix_hash, powers, range_hash

SHALLOW = 72
CHUNK_ROWS = 20_000
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of values[i:i + width] for every i; beyond the end counts as neutral."""
    pick = np.minimum if least else np.maximum
    n = len(values)
    size = -(-(n + width) // width) * width
    padded = np.full(size, _MOST if least else 0, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return pick(behind[:n], ahead[width - 1 : n + width - 1])


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of all anchors; windows and grams lie within documents."""
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(buf, False)
    at = np.arange(n - gram + 1)
    grams = range_hash(prefix, at, at + gram)
    end = np.repeat(off[1:], np.diff(off))
    grams[at + gram > end[: len(at)]] = _MOST
    width = length - gram + 1
    best = sliding(grams, width, True)
    best[at + length > end[: len(at)]] = 0  # no window starts here
    reach = sliding(best[::-1], width, False)[::-1]
    found = np.flatnonzero((reach == grams) & (grams != _MOST) & (grams != 0))
    return found, grams[found]


class BlindTrie:
    """Patricia trie over byte strings: nodes keep a depth and branch on one byte."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth, self.root = strings, depth, None

    def common(self, a: bytes, b: bytes) -> int:
        low, high = self.depth, len(a)
        while low < high:
            middle = (low + high + 1) // 2
            if a[low:middle] == b[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def insert(self, row: int) -> None:
        text = self.strings[row]
        if self.root is None:
            self.root = [row]
            return
        node = self.root
        while type(node) is tuple:  # blindly to some leaf
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        known = self.strings[node[0]]
        if known == text:
            node.append(row)
            return
        depth = self.common(known, text)
        parent, key, node = None, 0, self.root
        while type(node) is tuple and node[0] < depth:
            parent, key = node, text[node[0]]
            node = node[1][key]
        if type(node) is tuple and node[0] == depth:
            node[1][text[depth]] = [row]
            return
        split = (depth, {known[depth]: node, text[depth]: [row]})
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def deep_shallow_order(texts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Row order by (group, text); ``texts`` is a matrix of bytes, ``group`` is sorted."""
    order = np.arange(len(texts))
    part = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])]) if len(group) else group
    depth = min(SHALLOW, texts.shape[1] // 8 * 8)
    for d in range(0, depth, 8):
        size = np.bincount(part)
        at = np.flatnonzero(size[part] > 1)
        if not len(at):
            break
        word = np.ascontiguousarray(texts[order[at], d : d + 8]).view(">u8").ravel().astype(np.uint64)
        move = np.lexsort((word, part[at]))
        order[at] = order[at][move]
        new = np.ones(len(order), bool)
        new[1:] = part[1:] != part[:-1]
        differs = np.zeros(len(at), bool)
        differs[1:] = word[move][1:] != word[move][:-1]
        new[at] |= differs
        part = np.cumsum(new) - 1
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    for i in np.flatnonzero(np.diff(edges) > 1).tolist():
        rows = order[edges[i] : edges[i + 1]]
        trie = BlindTrie([bytes(texts[r]) for r in rows], depth)
        for k in range(len(rows)):
            trie.insert(k)
        order[edges[i] : edges[i + 1]] = rows[trie.order()]
    return order


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def widest_windows(right: np.ndarray, right_n: np.ndarray, left: np.ndarray, left_n: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) distance of a repeated window's start before the anchor; largest -1 if there is none.

    ``right`` holds the bytes from the anchor on and ``left`` those before it, reversed,
    both padded; ``group`` is sorted, and rows of different groups aren't compared.
    """
    n, reach = len(group), left.shape[1]
    low, high = np.full(n, length), np.full(n, -1)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(edges)
    a = edges[:-1][size == 2]
    r = np.minimum(common_prefix(right[a], right[a + 1]), np.minimum(right_n[a], right_n[a + 1]))
    m = np.minimum(common_prefix(left[a], left[a + 1]), np.minimum(left_n[a], left_n[a + 1]))
    hit = r + m >= length
    for rows in (a[hit], a[hit] + 1):
        low[rows], high[rows] = np.maximum(length - r[hit], 0), m[hit]

    rows = np.flatnonzero(np.repeat(size > 2, size))
    if not len(rows):
        return low, high
    group = group[rows]
    prefix, place = {}, {}
    for side, texts, sizes in (("r", right, right_n), ("l", left, left_n)):
        own = np.concatenate([texts[rows], sizes[rows].astype(np.uint8)[:, None]], 1)
        order = deep_shallow_order(own, group)
        sizes = sizes[rows][order]
        shared = np.zeros(len(rows), np.int64)
        shared[1:] = np.minimum(common_prefix(own[order[1:]], own[order[:-1]]), np.minimum(sizes[1:], sizes[:-1]))
        shared[1:][group[order[1:]] != group[order[:-1]]] = -1
        shared[0] = -1
        prefix[side], place[side] = shared, order
    low_r, high_r = np.full(len(rows), length), np.full(len(rows), -1)
    for from_far in (True, False):
        found = high_r if from_far else low_r
        open_rows = np.ones(len(rows), bool)
        for o in range(reach, -1, -1) if from_far else range(reach + 1):
            fits = open_group_fits(open_rows, group, right_n[rows] >= length - o, left_n[rows] >= o)
            if not len(fits):
                if not open_rows.any():
                    break
                continue
            ids = []
            for side, depth in (("r", length - o), ("l", o)):
                number = np.empty(len(rows), np.int64)
                number[place[side]] = np.cumsum(prefix[side] < depth)
                ids.append(number[fits])
            key = ids[0] * (len(rows) + 1) + ids[1]
            move = np.argsort(key, kind="stable")
            same = key[move][1:] == key[move][:-1]
            twice = np.zeros(len(key), bool)
            twice[move[1:]] = same
            twice[move[:-1]] |= same
            fresh = fits[twice]
            fresh = fresh[open_rows[fresh]]
            found[fresh] = o
            open_rows[fresh] = False
        if from_far:
            none = high_r < 0
            if none.all():
                break
    low[rows], high[rows] = low_r, high_r
    return low, high


def open_group_fits(open_rows: np.ndarray, group: np.ndarray, right_fits: np.ndarray, left_fits: np.ndarray) -> np.ndarray:
    """Rows that hold the window, of groups with a row that isn't settled."""
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    wanted = np.logical_or.reduceat(open_rows, edges)
    return np.flatnonzero(np.repeat(wanted, np.diff(np.append(edges, len(group)))) & right_fits & left_fits)


KEY = ["k1", "k2"]


def anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for chunk in chunks(batches):
            at, h = anchors(chunk.buf, chunk.off, length, gram)
            doc = np.searchsorted(chunk.off, at, "right") - 1
            keys = [np.asarray(chunk.rows.column(i))[doc] for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.array((at - chunk.off[doc]).astype(np.int32))], ["hash", "k1", "k2", "at"])

    return rows.select("k1", "text", "k2").mapInArrow(run, "hash long, k1 long, k2 long, at int")


def contexts(rows: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, k1, k2, at, before, text around) of the wanted anchors (hash, k1, k2, at)."""
    lists = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("at", "hash")).alias("list"))
    joined = rows.join(lists, KEY).select("k1", "k2", "doc_id", "text", "list")
    reach = length - gram

    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i in range(batch.num_rows):
                data = batch.column(3)[i].as_buffer()
                data = memoryview(data)
                items = batch.column(4)[i].values
                for at, h in zip(items.field(0).to_pylist(), items.field(1).to_pylist(), strict=True):
                    start = max(0, at - reach)
                    out.append((h, k1[i], k2[i], at, at - start, bytes(data[start : at + length])))
                if len(out) > CHUNK_ROWS:
                    yield table_of(out)
                    out = []
            if out:
                yield table_of(out)

    def table_of(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["hash", "k1", "k2", "at", "before", "around"])

    return joined.mapInArrow(run, "hash long, k1 long, k2 long, at int, before int, around binary")


def classes_of(found: DataFrame) -> DataFrame:
    """``found`` (contexts) with c1 and c2: 128 bits of the surroundings and the place of the anchor in them."""

    def run(batches):
        for batch in batches:
            before, around = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            digests = [hashlib.blake2b(x, digest_size=16, salt=b.to_bytes(8, "big")).digest() for x, b in zip(around, before, strict=True)]
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in pair.T)], [*batch.schema.names, "c1", "c2"])

    return found.mapInArrow(run, "hash long, k1 long, k2 long, at int, before int, around binary, c1 long, c2 long")


def class_spans(found: DataFrame, length: int, gram: int, hot_rows: int) -> DataFrame:
    """Removed ranges of the anchors of frequent grams: by class of equal surroundings, then for each anchor."""
    marked = cut(classes_of(found))
    size = F.length("around")
    classes = cut(marked.groupBy("hash", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("around").alias("around")))
    # windows that two equal surroundings hold are repeated, from the first to the last of them
    whole = classes.where((F.col("n") > 1) & (size >= length)).select("c1", "c2", (-F.col("before")).cast("long").alias("start"), (size - F.col("before")).cast("long").alias("stop"))
    per_gram = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    one_of_each = classes.join(per_gram, "hash").select("hash", F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.lit(0).alias("at"), "before", "around", "m")
    few = one_of_each.where(F.col("m") <= hot_rows).drop("m")
    many = one_of_each.where(F.col("m") > hot_rows).drop("m")
    spans = sorted_spans(few.repartition("hash").sortWithinPartitions("hash"), length, gram)
    if many.limit(1).count():
        spans = spans.unionByName(counted_spans(many, length, gram))
    spans = whole.unionByName(spans.withColumnsRenamed({"k1": "c1", "k2": "c2"})).groupBy("c1", "c2").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return marked.select("c1", "c2", "k1", "k2", "at").join(spans, ["c1", "c2"]).select("k1", "k2", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))


def frequent_grams(rows: DataFrame, length: int, gram: int, hot_rows: int, share: int = 16, limit: int = 1 << 17) -> DataFrame:
    """Grams that a sixteenth of the texts shows to be frequent; it only says how rows are dealt, never what comes out."""
    part = rows.where(F.pmod(F.xxhash64("k2", F.lit(1)), F.lit(share)) == 0)
    return anchor_rows(part, length, gram).groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * share > hot_rows).orderBy(F.desc("c"), "hash").limit(limit).select("hash")


def sorted_spans(found: DataFrame, length: int, gram: int) -> DataFrame:
    """Removed ranges (k1, k2, start, stop) from contexts, one hash group after another."""
    reach = length - gram

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                rows = pa.Table.from_batches(held)
                h = rows.column(0).to_numpy()
                last = len(h) - int(np.argmax(h[::-1] != h[-1])) if h[0] != h[-1] else 0
                yield from solve(rows.slice(0, last))
                held = rows.slice(last).to_batches()
                size = len(h) - last
        if held:
            yield from solve(pa.Table.from_batches(held))

    def solve(rows):
        if not rows.num_rows:
            return
        before = rows.column(4).to_numpy().astype(np.int64)
        around = rows.column(5).to_pylist()
        right_n = np.array([len(x) for x in around]) - before
        right = b"".join(x[b:].ljust(length, b"\0") for x, b in zip(around, before.tolist(), strict=True))
        left = b"".join(x[:b][::-1].ljust(reach, b"\0") for x, b in zip(around, before.tolist(), strict=True))
        right = np.frombuffer(right, np.uint8).reshape(-1, length)
        left = np.frombuffer(left, np.uint8).reshape(-1, reach)
        low, high = widest_windows(right, right_n, left, before, rows.column(0).to_numpy(), length)
        hit = high >= 0
        at = rows.column(3).to_numpy().astype(np.int64)[hit]
        keys = [rows.column(i).to_numpy()[hit] for i in (1, 2)]
        if len(at):
            yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys), pa.array(at - high[hit]), pa.array(at - low[hit] + length)], ["k1", "k2", "start", "stop"])

    return found.mapInArrow(run, "k1 long, k2 long, start long, stop long")


def counted_spans(found: DataFrame, length: int, gram: int) -> DataFrame:
    """The same ranges for very large groups: windows are counted by a 128-bit hash.

    A window may hold the gram of its anchor several times. It counts at the first of
    them only, hence once for each place; equal windows have theirs at the same offset.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                before = part.column(4).to_numpy().astype(np.int64)
                around = part.column(5).to_pylist()
                buf = np.frombuffer(b"".join(around), np.uint8)
                off = np.concatenate([[0], np.cumsum([len(x) for x in around])])
                prefix = prefix_hash(buf, False)
                ends = np.minimum(np.arange(len(buf)) + gram, len(buf))
                grams = range_hash(prefix, np.arange(len(buf)), ends)
                own = np.repeat(np.arange(len(around)), np.diff(off))
                place = np.arange(len(buf)) - off[own]
                same = np.flatnonzero((place < before[own]) & (grams == grams[off[:-1] + before][own]))
                low = np.zeros(len(around), np.int64)
                np.maximum.at(low, own[same], place[same] + 1)  # windows from here on don't hold an earlier one
                n = np.maximum(np.minimum(before + 1, np.diff(off) - length + 1) - low, 0)
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
                h1 = range_hash(prefix, off[row] + at, off[row] + at + length)
                folded = np.zeros(len(buf) + 1, np.uint64)
                base = 0xA0761D6478BD642F
                np.cumsum(mix(buf.astype(np.uint64) + np.uint64(77)) * powers(len(buf), base), out=folded[1:])
                inverse = powers(len(folded), pow(base, -1, 1 << 64))
                h2 = mix((folded[off[row] + at + length] - folded[off[row] + at]) * inverse[off[row] + at])
                where = part.column(3).to_numpy().astype(np.int64)[row] - before[row] + at
                columns = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(pa.array(part.column(i).to_numpy()[row]) for i in (0, 1, 2)), pa.array(part.column(3).to_numpy()[row]), pa.array(where)]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "hash", "k1", "k2", "at", "start"])

    windows = found.mapInArrow(run, "h1 long, h2 long, hash long, k1 long, k2 long, at int, start long")
    twice = windows.groupBy("h1", "h2", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spans = windows.join(twice, ["h1", "h2", "hash"]).groupBy("k1", "k2", "at").agg(F.min("start").alias("start"), (F.max("start") + length).alias("stop"))
    return spans.select("k1", "k2", "start", "stop")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 64, hot_rows: int = 100_000, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, on demand, kept_bytes).

    A null text is empty; texts under ``length`` bytes lose nothing; texts of any length are
    taken whole. Repeated rows are places of their own, so a row that occurs twice loses
    all its bytes (from ``length`` on). Null ids are rows like others. Ties need no rule:
    all places of a repeated string go. Other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(text).alias("k2"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    frequent = cut(frequent_grams(rows, length, gram, hot_rows)).withColumn("hot", F.lit(True))
    every = anchor_rows(rows, length, gram).join(F.broadcast(frequent), "hash", "left")
    # anchors of frequent grams are dealt by place; the others are counted
    part = F.when(F.col("hot"), F.pmod(F.xxhash64(*KEY, "at"), F.lit(4096))).otherwise(0)
    every = every.withColumn("part", part).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("hash", "part")))
    twice = cut(every.select("hash", *KEY, "at", F.when(F.col("hot"), hot_rows + 1).otherwise(F.col("c")).alias("c")).where("c > 1"))
    found = contexts(rows, twice.where(F.col("c") <= hot_rows).select("hash", *KEY, "at"), length, gram)
    spans = sorted_spans(found.repartition("hash").sortWithinPartitions("hash"), length, gram)
    hot = twice.where(F.col("c") > hot_rows)
    if hot.limit(1).count():
        # only texts that may hold a frequent gram are shuffled a second time
        held = with_possible(rows, "k2", bit_table(hot, "k2"), "possible").where("possible")
        spans = spans.unionByName(class_spans(contexts(held, hot.select("hash", *KEY, "at"), length, gram), length, gram, hot_rows))
    lists = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("list"))
    joined = rows.join(lists, KEY, "left").select("k1", "k2", "doc_id", "text", "list")

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = batch.column(3)[i].as_buffer() if batch.column(3)[i].is_valid else b""
                data = bytes(data) if not isinstance(data, bytes) else data
                kept, at, removed, runs = [], 0, 0, 0
                item = batch.column(4)[i]
                if item.is_valid:
                    reached = -1
                    for start, stop in sorted(zip(item.values.field(0).to_pylist(), item.values.field(1).to_pylist(), strict=True)):
                        if start > reached:
                            kept.append(data[at:start])
                            runs += 1
                            removed += stop - start
                            reached = stop
                        elif stop > reached:
                            removed += stop - reached
                            reached = stop
                        at = reached
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(2), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    result = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return result if with_text else result.drop("kept_bytes")
