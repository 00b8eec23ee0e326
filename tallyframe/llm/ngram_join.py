"""N-gram Jaccard join with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Two
documents link when 100 * |intersection| >= percent * |union|.

*Equal sets* are one class. *Families*: sets that share one of four min-hashes are
offered the smallest such set as a leader; those that link with it, with the
difference to it kept, are its members and already belong to its component.

*Index lists* hold, for each shingle among the rarest of a set (the prefix that any
partner must touch), the sets' size and how much follows the shingle. A list is a
sequence of blocks of one size, each ordered by position. Two blocks are compared as
a whole: once the shorter remainder can't reach the needed overlap, the rest of the
block is skipped. Rareness comes from a bounded table of the most frequent shingles;
it moves work, never results.

Entries without a partner of another family and of a fitting size leave their list
first. Counts of elements in hash buckets travel with the others and bound every
pair's overlap; pairs that can't reach the threshold are not sent on. A list of many
sets is dealt into cells, each a task's work of its own.

*Answers from similar sets*: only leaders are intersected. By the triangle inequality
of Jaccard distance no members can link if the leaders are further apart than the
threshold plus both radii. Otherwise, and inside a family, the members' overlaps are
derived from the leaders' intersection and the members' differences, with no set read
again, a block of members against another at once. What comes out is the number of
links of each member and whether two families touch, never the pairs.

Components come from the verified links (``graph.components``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tallyframe.llm.graph import components
from tallyframe.llm.prefilter import bit_table, fresh, with_possible
from tallyframe.llm.store import cut
from tallyframe.llm.text import Chunk, chunks, mix, sequence_hash, spans, word_hashes

SIGNATURES = 4
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
MEMBERS_PER_BLOCK = 256
CELL = 8192
COLUMNS = 8192


def shingle_sets(chunk: Chunk, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; fewer than k words are one shingle."""
    starts, ends, woff = spans(chunk.buf, chunk.off)
    words = word_hashes(chunk.buf, starts, ends)
    grams = sequence_hash(words, k)
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            if len(s) > 1:
                fresh = np.empty(len(s), bool)
                fresh[0] = True
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                s = s[fresh]
            yield s
        elif b > a:
            yield sequence_hash(words[a:b], b - a)
        else:
            yield words[:0]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in two signed numbers."""
    a, b = mix(s ^ _SEEDS[0]).sum(dtype=np.uint64), mix(s + _SEEDS[1]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def needed_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest intersection that links sets of sizes that add up to n."""
    return -(-percent * n // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def bucket_counts(s: np.ndarray) -> bytes:
    """How many elements fall into each of about n / 8 hash buckets (15: at least so many), two counts a byte."""
    bits = max(4, (len(s) // 8).bit_length())
    counts = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (counts[::2] << 4 | counts[1::2]).tobytes()


def signatures(docs: DataFrame, k: int, hot_local: int = 8) -> DataFrame:
    """kind 0: id, n, f1, f2, m0..m3, buckets of each document; kind 1: f1 = a shingle of many documents of one task, n = how many."""

    def run(batches):
        often: dict[int, int] = {}
        for chunk in chunks(batches):
            sets = list(shingle_sets(chunk, k))
            rows = np.zeros((len(sets), 3 + SIGNATURES), np.int64)
            for i, s in enumerate(sets):
                if len(s):
                    rows[i, 0] = len(s)
                    rows[i, 1:3] = fingerprint(s)
                    for j, seed in enumerate(_SEEDS):
                        rows[i, 3 + j] = mix(s * seed + seed).min().view(np.int64)
            yield table(np.zeros(len(sets), np.int32), chunk.ids, rows, [bucket_counts(x) for x in sets])
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            if len(every):
                at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                n = np.diff(np.append(at, len(every)))
                for h, c in zip(every[at[n > 2]].tolist(), n[n > 2].tolist(), strict=True):
                    often[h] = often.get(h, 0) + c
                if len(often) > 200_000:
                    often = {h: c for h, c in often.items() if c >= hot_local}
        kept = [(h, c) for h, c in often.items() if c >= hot_local]
        if kept:
            rows = np.zeros((len(kept), 3 + SIGNATURES), np.int64)
            rows[:, 0] = [c for _, c in kept]
            rows[:, 1] = np.array([h for h, _ in kept], np.uint64).view(np.int64)
            yield table(np.ones(len(kept), np.int32), pa.nulls(len(kept), pa.int64()), rows, [None] * len(kept))

    names = ["n", "f1", "f2", *(f"m{j}" for j in range(SIGNATURES))]

    def table(kind, ids, rows, buckets):
        columns = [pa.array(kind), ids, *(pa.array(np.ascontiguousarray(c)) for c in rows.T), pa.array(buckets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "id", *names, "buckets"])

    return docs.mapInArrow(run, "kind int, id long, " + ", ".join(f"{x} long" for x in names) + ", buckets binary")


def may_link(left: list[bytes], right: list[bytes], sizes: np.ndarray, slack: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of bucket counts: can the sets be within the threshold plus ``slack`` of Jaccard distance?

    ``sizes`` has a row for each pair. No intersection is larger than the sum of the
    smaller counts of all buckets, the finer of the two folded to the coarser.
    """
    n = len(left)
    lengths = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(n, 2)
    bound = np.zeros(n, np.int64)
    for shape in np.unique(lengths, axis=0):
        rows = np.flatnonzero((lengths == shape).all(1))
        m, step = int(shape.min()), max(1, (2 << 20) // int(shape.max()))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            folded = []
            for side in (left, right):
                v = np.frombuffer(b"".join(side[i] for i in part.tolist()), np.uint8)
                v = np.stack([v >> 4, v & 15], 1).reshape(len(part), 2 * m, -1).astype(np.int32)
                folded.append(np.where(v == 15, 1 << 24, v).sum(2, dtype=np.int64))
            bound[part] = np.minimum(*folded).sum(1)
    bound = np.minimum(bound, sizes.min(1))
    return 1 - bound / np.maximum(sizes.sum(1) - bound, 1) <= 1 - percent / 100 + slack + 1e-9


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that bucket counts and sizes allow, with f1 of both sides as fa and fb."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("f1").alias(f"f{x}"), F.col("n").alias(f"n{x}"), F.col("buckets").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "fa", "fb", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            sizes = np.stack([batch.column(i).to_numpy() for i in (4, 5)], 1)
            keep = may_link(batch.column(6).to_pylist(), batch.column(7).to_pylist(), sizes, np.zeros(batch.num_rows), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "fa", "fb"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long, fa long, fb long")


def frequent_shingles(found: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and the logarithm of their counts, at most ``limit``."""
    top = found.where("kind = 1").groupBy("f1").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "f1").limit(limit).collect()
    h = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([min(62, r[1].bit_length()) for r in top], np.uint64)[order]


def sort_keys(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys in the order of rareness: infrequent shingles by hash, then frequent ones by rising count."""
    keys = s >> np.uint64(1)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], s), len(hot[0]) - 1)
        is_hot = hot[0][at] == s
        keys[is_hot] = np.uint64(1 << 63) | (hot[1][at[is_hot]] << np.uint64(57)) | (s[is_hot] >> np.uint64(7))
    return keys


def index_rows(docs: DataFrame, k: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, f1, n, rest) for the prefix of every set; equal sets of several tasks give equal rows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        table, seen = shared.value, set()
        for chunk in chunks(batches):
            token, owner, size, rest = [], [], [], []
            for s in shingle_sets(chunk, k):
                n = len(s)
                if not n:
                    continue
                f1, f2 = fingerprint(s)
                if (n, f1, f2) in seen:
                    continue
                seen.add((n, f1, f2))
                p = prefix_length(n, percent)
                keys = sort_keys(s, table)
                keys = np.sort(np.partition(keys, p - 1)[:p]) if p < n else np.sort(keys)
                token.append(keys)
                owner.append(np.full(p, f1))
                size.append(np.full(p, n, np.int32))
                rest.append(n - 1 - np.arange(p, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (owner, size, rest))], ["token", "f1", "n", "rest"])

    return docs.select("id", "text").mapInArrow(run, "token long, f1 long, n int, rest int")


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """Index rows that meet another set of a fitting size in their list, with the ``length`` of what is left of it.

    In the order of sizes a set fits one of its neighbours or none. Rows are dealt out
    by token once, for all three steps; equal rows become one when most are gone.
    """
    sizes = Window.partitionBy("token").orderBy("n")
    before, after, n = F.lag("n").over(sizes).cast("long"), F.lead("n").over(sizes).cast("long"), F.col("n").cast("long")
    near = rows.repartition("token").withColumn("before", before).withColumn("after", after)
    near = near.where((100 * F.col("before") >= percent * n) | (100 * n >= percent * F.col("after")))
    once = near.groupBy("token", "f1", "n").agg(F.max("rest").alias("rest"))
    return once.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("length > 1")


def of_several_families(lists: DataFrame, percent: int) -> DataFrame:
    """(list, fam, n, rest), once each, of lists in which two families meet; where only two entries do, they can reach the overlap."""
    once = lists.repartition("list").groupBy("list", "fam", "n").agg(F.max("rest").alias("rest"))
    w = Window.partitionBy("list")
    what = {"entries": F.count(F.lit(1)), "one": F.min("fam"), "other": F.max("fam"), "small": F.min("n"), "large": F.max("n"), "least": F.min("rest")}
    marked = once.select("*", *(c.over(w).alias(x) for x, c in what.items()))
    size = F.col("small").cast("long") + F.col("large")
    pair = (100 * F.col("small").cast("long") >= percent * F.col("large").cast("long")) & ((100 + percent) * (1 + F.col("least").cast("long")) >= percent * size)
    return marked.where((F.col("one") < F.col("other")) & ((F.col("entries") > 2) | pair)).select("list", "fam", "n", "rest")


def split_long_lists(lists: DataFrame) -> DataFrame:
    """``lists`` (token, length, f1, ...) with ``list`` in place of token: a list of over CELL sets becomes cells.

    Its sets are dealt into groups; each pair of groups is a list of its own, so that
    no task holds a frequent token's list and every pair of sets still meets.
    """
    groups = F.ceil(F.col("length") / CELL).cast("int")
    own = F.pmod(F.xxhash64("f1"), groups).cast("int")
    cells = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.xxhash64("token", F.least(own, g), F.greatest(own, g)))
    return lists.withColumn("list", F.explode(F.when(groups > 1, cells).otherwise(F.array("token")))).drop("token", "length")


def candidate_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, ra, rb, fa, fb), a < b, of families whose blocks in some list can reach the needed overlap.

    ``lists`` has (list, fam, n, rest, f1, size, radius, buckets), the latter four of the
    family's leader, and comes in the order of list, n, falling rest. A pair whose
    leaders' bucket counts rule a link out, radii included, isn't sent on.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and held[-1].column(0)[-1].as_py() == batch.column(0)[-1].as_py():
                held.append(batch)  # the list goes on
                continue
            rows = pa.Table.from_batches([*held, batch])
            tokens = rows.column(0).to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))[-1])
            yield from pairs_of(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    def pairs_of(rows):
        if rows.num_rows < 2:
            return
        token, fam, n, rest, f1, size, radius = (rows.column(i).to_numpy() for i in range(7))
        n, rest = n.astype(np.int64), rest.astype(np.int64)
        signature = rows.column(7).to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        length = np.diff(edge)
        two = edge[:-1][length == 2]  # most lists: one pair each
        good = 1 + np.minimum(rest[two], rest[two + 1]) >= needed_overlap(n[two] + n[two + 1], percent)
        good &= 100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1])
        found, held = [(two[good], two[good] + 1)], int(good.sum())
        for start in np.flatnonzero(length > 2).tolist():
            at, stop = int(edge[start]), int(edge[start + 1])
            cut_at = at + np.flatnonzero(np.concatenate([[True], n[at + 1 : stop] != n[at : stop - 1], [True]]))
            blocks = list(zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True))
            for i, (a, b) in enumerate(blocks):
                for c, d in blocks[i:]:
                    if 100 * n[a] < percent * n[c]:
                        break
                    # each block is ordered by position: beyond these entries none can reach the overlap
                    need = needed_overlap(int(n[a] + n[c]), percent)
                    x, y = a + np.searchsorted(-rest[a:b], 1 - need, "right"), c + np.searchsorted(-rest[c:d], 1 - need, "right")
                    for low in range(a, int(x), 64):
                        left = np.arange(low, min(x, low + 64))
                        found.append((np.repeat(left, y - c), np.tile(np.arange(c, y), len(left))))
                        held += len(found[-1][0])
                        if held > 200_000:
                            yield from emit(found, fam, f1, size, radius, signature)
                            found, held = [], 0
        yield from emit(found, fam, f1, size, radius, signature)

    def emit(found, fam, f1, size, radius, signature):
        i, j = (np.concatenate([p[side] for p in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
        swap = fam[i] > fam[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if not len(i):
            return
        _, first = np.unique(np.stack([fam[i], fam[j]], 1), axis=0, return_index=True)
        first = first[fam[i[first]] != fam[j[first]]]
        i, j = i[first], j[first]
        keep = may_link([signature[x] for x in i.tolist()], [signature[x] for x in j.tolist()], np.stack([size[i], size[j]], 1), radius[i] + radius[j], percent)
        i, j = i[keep], j[keep]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (fam[i], fam[j], radius[i], radius[j], f1[i], f1[j])], ["a", "b", "ra", "rb", "fa", "fb"])

    return lists.mapInArrow(run, "a long, b long, ra double, rb double, fa long, fb long").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, f1, tokens), once each: the sorted shingles of documents that a bit table of the wanted ids lets through.

    Only their sets are shuffled by the joins that follow, not all texts.
    """
    rows = with_possible(docs.select("id", "text"), "id", bit_table(wanted, "id"), "wanted").where("wanted").select("id", "text")

    def run(batches):
        for chunk in chunks(batches):
            sets = list(shingle_sets(chunk, k))
            f1 = [fingerprint(s)[0] if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(f1, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "f1", "tokens"])

    return rows.mapInArrow(run, "id long, f1 long, tokens binary").groupBy("id", "f1").agg(F.first("tokens").alias("tokens"))


def as_set(data) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint64) if data.is_valid and len(data.as_buffer()) else np.zeros(0, np.uint64)


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def compare(docs: DataFrame, pairs: DataFrame, k: int, extra: list[str], differences: bool) -> DataFrame:
    """pairs (a, b, fa, fb, extra...) with na, nb and the exact overlap; with ``differences`` also b's to a: gone, more."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = sets_of(docs, ids, k)
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("f1").alias("fb"), F.col("tokens").alias("tb")), ["b", "fb"])
    both = left.join(sets.select(F.col("id").alias("a"), F.col("f1").alias("fa"), F.col("tokens").alias("ta")), ["a", "fa"]).select("a", "b", *extra, "ta", "tb")
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("a", "b", *extra)) + ", na long, nb long, overlap long"
    schema += ", gone binary, more binary" if differences else ""

    def run(batches):
        for batch in batches:
            ta, tb = batch.column(2 + len(extra)), batch.column(3 + len(extra))
            numbers, gone, more = np.zeros((batch.num_rows, 3), np.int64), [], []
            for i in range(batch.num_rows):
                x, y = as_set(ta[i]), as_set(tb[i])
                common = is_in(y, x)
                numbers[i] = len(x), len(y), common.sum()
                if differences:
                    gone.append(x[~is_in(x, y)].tobytes())
                    more.append(y[~common].tobytes())
            columns = [*batch.columns[: 2 + len(extra)], *(pa.array(np.ascontiguousarray(c)) for c in numbers.T)]
            columns += [pa.array(gone, pa.binary()), pa.array(more, pa.binary())] if differences else []
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return both.mapInArrow(run, schema)


def linked(percent: int):
    return 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))


@dataclass
class Block:
    """Members of a family: ids, set sizes, copies, and their differences to the leader as signed elements."""

    ids: np.ndarray
    size: np.ndarray
    copies: np.ndarray
    owner: np.ndarray
    token: np.ndarray
    sign: np.ndarray

    @classmethod
    def of(cls, members: list[dict]) -> Block:
        parts = [(i, np.frombuffer(m[c], np.uint64), s) for i, m in enumerate(members) for c, s in (("gone", -1), ("more", 1))]
        owner = np.concatenate([np.full(len(v), i) for i, v, _ in parts])
        sign = np.concatenate([np.full(len(v), s, np.float32) for _, v, s in parts])
        return cls(*(np.array([m[c] for m in members], np.int64) for c in ("member", "size", "copies")), owner, np.concatenate([v for _, v, _ in parts]), sign)

    def within(self, leader: np.ndarray) -> np.ndarray:
        """What each member has more of a sorted set than its own leader has."""
        return np.bincount(self.owner, self.sign * is_in(self.token, leader), len(self.ids)).astype(np.int64)

    def columns(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), len(tokens)), np.float32)
        mine = is_in(self.token, tokens)
        out[self.owner[mine], np.searchsorted(tokens, self.token[mine])] = self.sign[mine]
        return out


def derived_overlaps(p: Block, q: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All overlaps of two blocks' members, whose leaders are x and y, with no member's set read.

    With d the signed difference of a member to its leader, |p & q| = |x & y| + d_p on y + d_q on x + d_p * d_q.
    """
    out = int(is_in(x, y).sum()) + p.within(y)[:, None] + q.within(x)[None, :]
    both = np.intersect1d(p.token, q.token)
    for start in range(0, len(both), COLUMNS):
        part = both[start : start + COLUMNS]
        out += np.rint(p.columns(part) @ q.columns(part).T).astype(np.int64)
    return out


def derived_links(docs: DataFrame, pairs: DataFrame, members: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the members of pairs of families (a, b; a = b: inside one).

    Rows (a, b, null): some members of a and b link. Rows (a, null, n): the set of id a
    links with n documents. ``members`` (fam, member, size, copies, gone, more; leaders
    included) come in blocks of about MEMBERS_PER_BLOCK; a row has one block of either side.
    """
    parts = members.groupBy("fam").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_BLOCK).cast("int").alias("parts"))
    placed = members.join(parts, "fam").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    blocks = cut(placed.groupBy("fam", "part").agg(F.collect_list(F.struct("member", "size", "copies", "gone", "more")).alias("list")))
    have = blocks.select("fam", "part")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(docs, ids, k).join(reps.select(F.col("rep").alias("id"), "f1"), ["id", "f1"]).select("id", "tokens")
    rows = pairs.select("a", "b").join(have.select(F.col("fam").alias("a"), F.col("part").alias("i")), "a")
    rows = rows.join(have.select(F.col("fam").alias("b"), F.col("part").alias("j")), "b").where("a <> b or i <= j")
    for side, part in (("a", "i"), ("b", "j")):
        rows = rows.join(blocks.select(F.col("fam").alias(side), F.col("part").alias(part), F.col("list").alias(f"l{side}")), [side, part])
    for side in ("a", "b"):
        rows = rows.join(sets.select(F.col("id").alias(side), F.col("tokens").alias(f"t{side}")), side)
    rows = rows.select("a", "b", "i", "j", "ta", "tb", "la", "lb")

    def run(batches):
        for batch in batches:
            count: dict[int, int] = {}
            joined = []
            for r in range(batch.num_rows):
                a, b, i, j = (batch.column(c)[r].as_py() for c in range(4))
                p, q = (Block.of(batch.column(c)[r].as_py()) for c in (6, 7))
                x, y = (as_set(batch.column(c)[r]) for c in (4, 5))
                overlap = derived_overlaps(p, q, x, y)
                link = 100 * overlap >= percent * (p.size[:, None] + q.size[None, :] - overlap)
                if a == b:
                    link &= p.ids[:, None] != q.ids[None, :]
                elif link.any():
                    joined.append((a, b))
                sides = [(p, link @ q.copies)] if (a, i) == (b, j) else [(p, link @ q.copies), (q, link.T @ p.copies)]
                for block, n in sides:
                    for at in np.flatnonzero(n).tolist():
                        count[int(block.ids[at])] = count.get(int(block.ids[at]), 0) + int(n[at])
            joined = sorted(set(joined))
            a = [x for x, _ in joined] + list(count)
            b = [y for _, y in joined] + [None] * len(count)
            n = [None] * len(joined) + list(count.values())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, frequent: int = 1 << 17, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id (smallest id with an equal set), n_links.

    n_links counts the other rows whose sets link, rows with an equal set included (0
    for sets that only rows without an id have, which aren't compared); it is null unless ``count_links``, which also spares the links that join no components.

    Null or empty texts, and those without words, have an empty set and are linked with
    nothing. Texts of any length are taken whole. Rows with a null id are kept; they take
    part in the class of their set, and component_id is null only if no id is known in
    it. Repeated rows are kept and are equal; ties go to the smallest id. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    classes = _classes(rows, k, percent, frequent, count_links)
    return classes.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"), "n_links")


def _classes(rows: DataFrame, k: int, percent: int, frequent: int, count_links: bool) -> DataFrame:
    """(id, n, f1, f2, class_id, component_id, n_links) for every row (id, text)."""
    found = cut(signatures(rows, k))
    hot = frequent_shingles(found, frequent)
    own = found.where("kind = 0")
    key = ["n", "f1", "f2"]
    per_set = own.where("n > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in (*(f"m{j}" for j in range(SIGNATURES)), "buckets")])
    reps = cut(per_set.where("rep is not null"))

    # families: each set is offered the smallest set that shares a signature
    sig = reps.select("rep", "n", F.posexplode(F.array(*[f"m{j}" for j in range(SIGNATURES)])).alias("j", "m"))
    lead = sig.groupBy("j", "m").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("j", "m", "lead")
    offers = sig.join(lead, ["j", "m"]).where("lead.rep < rep").where(100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n"))
    offers = offers.groupBy(F.col("rep").alias("b")).agg(F.min("lead.rep").alias("a"))
    offers = cut(possible(offers.select("a", "b"), reps, percent))
    joined = cut(compare(rows, offers, k, [], True).where(linked(percent)))
    # a leader must not itself be a member
    members = joined.join(joined.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    members = members.select(F.col("a").alias("fam"), F.col("b").alias("member"), F.col("nb").alias("size"), "na", "overlap", "gone", "more").dropDuplicates(["member"])
    members = cut(members.join(reps.select(F.col("rep").alias("member"), "copies"), "member"))
    radius = F.max(1 - F.col("overlap") / (F.col("na") + F.col("size") - F.col("overlap")))
    families = members.groupBy("fam").agg(radius.alias("radius"), F.count(F.lit(1)).alias("c"))

    # index lists of at least two sets, then of families; a bit table leaves out most copies
    first = with_possible(rows, "id", bit_table(reps, "rep"), "first").where("first")
    lists = with_partners(index_rows(first, k, percent, hot), percent)
    of = reps.select("f1", "n", "rep").join(members.select(F.col("member").alias("rep"), "fam"), "rep", "left").select("f1", "n", F.coalesce("fam", "rep").alias("fam"))
    lists = of_several_families(split_long_lists(lists).join(of, ["f1", "n"]), percent)
    leaders = reps.select(F.col("rep").alias("fam"), "f1", F.col("n").alias("size"), "buckets").join(families.select("fam", "radius"), "fam", "left").fillna(0.0, ["radius"])
    lists = lists.join(leaders, "fam").repartition("list").sortWithinPartitions("list", "n", F.desc("rest"), "fam")
    pairs = cut(candidate_pairs(lists.select("list", "fam", "n", "rest", "f1", "size", "radius", "buckets"), percent))
    judged = cut(compare(rows, pairs, k, ["ra", "rb"], False))
    distance = 1 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))
    edges = joined.select("a", "b").unionByName(judged.where(linked(percent)).select("a", "b"))
    near = judged.where((F.col("ra") + F.col("rb") > 0) & (distance <= 1 - percent / 100 + F.col("ra") + F.col("rb") + 1e-9)).select("a", "b")
    if count_links:
        near = near.unionByName(families.where("c > 1").select(F.col("fam").alias("a"), F.col("fam").alias("b")))
    else:  # only links that join components
        known = cut(components(edges))
        for side in ("a", "b"):
            near = near.join(known.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left")
        near = near.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    near = cut(near)
    counts = None
    if near.limit(1).count():
        named = near.select(F.col("a").alias("fam")).unionByName(near.select(F.col("b").alias("fam"))).distinct()
        listed = members.join(named, "fam", "left_semi").select("fam", "member", "size", "copies", "gone", "more")
        empty = F.lit(b"")
        themselves = named.join(reps.select(F.col("rep").alias("fam"), "n", "copies"), "fam").select("fam", F.col("fam").alias("member"), F.col("n").alias("size"), "copies", empty.alias("gone"), empty.alias("more"))
        derived = cut(derived_links(rows, near, listed.unionByName(themselves), reps, k, percent))
        edges = edges.unionByName(derived.where("b is not null").select("a", "b"))
        counts = derived.where("b is null").select(F.col("a").alias("rep"), "n")
    linked_sets = components(edges)
    classes = reps.select(*key, "rep", "copies").join(linked_sets.withColumnRenamed("id", "rep"), "rep", "left")
    if count_links:
        # what isn't derived: links of two sets that are families of their own, and of a leader with its only member
        alone = judged.where(linked(percent) & (F.col("ra") + F.col("rb") == 0)).select("a", "b")
        alone = alone.unionByName(members.join(families.where("c = 1").select("fam"), "fam").select(F.col("fam").alias("a"), F.col("member").alias("b")))
        both = alone.unionByName(alone.select(F.col("b").alias("a"), F.col("a").alias("b")))
        direct = both.join(reps.select(F.col("rep").alias("b"), "copies"), "b").select(F.col("a").alias("rep"), F.col("copies").alias("n"))
        counts = direct if counts is None else counts.unionByName(direct)
        classes = classes.join(counts.groupBy("rep").agg(F.sum("n").alias("links")), "rep", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1 if count_links else F.lit(None).cast("long")
    classes = classes.select(*key, F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), links.alias("n_links"))
    out = own.select("id", *key).join(classes, key, "left")
    return out.select("id", *key, "class_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links") if count_links else F.col("n_links"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, once each, with all their columns.

    Documents without words stay (null and empty texts included), each of them. Rows
    without an id can't be named by a link and stay as well. Rows that repeat an id and
    its set count as one; a repeated id with another text is judged on its own. Texts
    are compared whole. Columns may have any names. An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut(_classes(rows, k, percent, 1 << 17, False))
    kept = (F.col("component_id").isNull()) | (F.col("id") == F.col("component_id"))
    named = found.where("id is not null")
    if named.groupBy("id").count().where("count > 1").limit(1).count():
        return _keep_of_repeated(docs, id_col, text_col, named.where(kept), k)
    # few rows go: those that certainly stay need no shuffle
    gone, flag = fresh(docs.columns, "gone"), fresh(docs.columns, "possible")
    ids = named.where(~kept).select(F.col("id").alias(gone))
    marked = with_possible(docs, id_col, bit_table(ids, gone), flag)
    maybe = marked.where(F.col(flag)).join(ids, F.col(id_col).cast("long") == F.col(gone), "left_anti")
    return marked.where(~F.col(flag)).unionByName(maybe).select(*docs.columns)


def _keep_of_repeated(docs: DataFrame, id_col: str, text_col: str, kept: DataFrame, k: int) -> DataFrame:
    """Where ids repeat: rows of the kept (id, set), one for each, and all rows without an id."""
    order = [id_col, text_col, *(c for c in docs.columns if c not in (id_col, text_col))]
    names = [fresh(docs.columns, x) for x in ("id", "n", "f1", "f2")]
    named = docs.where(F.col(id_col).isNotNull()).select(*order)

    def run(batches):
        for chunk in chunks(batches):
            sets = list(shingle_sets(chunk, k))
            marks = np.array([(len(s), *(fingerprint(s) if len(s) else (0, 0))) for s in sets], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*chunk.rows.columns, *(pa.array(np.ascontiguousarray(c)) for c in marks.T)], [*order, *names[1:]])

    schema = StructType([*named.schema.fields, *(StructField(x, LongType()) for x in names[1:])])
    marked = named.mapInArrow(run, schema).withColumn(names[0], F.col(id_col).cast("long"))
    of = kept.select(*[F.col(c).alias(x) for c, x in zip(("id", "n", "f1", "f2"), names, strict=True)]).distinct()
    out = marked.join(of, names, "left_semi").dropDuplicates(names).select(*docs.columns)
    return out.unionByName(docs.where(F.col(id_col).isNull()))
