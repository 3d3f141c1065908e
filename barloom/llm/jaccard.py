"""N-gram Jaccard join: classes of equal shingle sets, and the components of those whose similarity reaches a threshold.

A set holds 64-bit hashes of a text's shingles, in one order for all: shingles that are frequent come last. Equal sets are one
class from the start, told apart by a 64-bit digest.

Which classes can meet. The hash range is cut in slices of some 32 to 64 shingles of a set. If two sets are similar, they are so within
at least one slice, and there they share one of the first shingles, a fifth of the slice's and one more. Rows meet by these, with
64 parity bits of their slice: two slices differ in at least as many shingles as their bits. That says which classes may belong
together, without a pair being written down: each group hands on a forest.

The join. Each cluster of such classes is brought together with its whole sets, in tiles where it is large, and stored in a prefix
tree: one edge for shingles that several sets, or one set, go through without a fork. Sets walk down the tree side by side; a
node's overlap is counted once for all sets below, and a subtree is left when the shingles that remain on either side cannot make
up the overlap that its sizes ask for, or when all its sets are linked to the walking one already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written
from .simhash import components, joined_up
from .words import LOWER, binaries, coded, plain, ragged, raw, runs_of, slices

SHINGLE, SLICE = 5, 1 << 20
#: Similarity of at least 80 in 100: 9 times the overlap is at least 4 times the sum of the sizes, and a fifth of a set may be missing.
SHARE, OF = 80, 100
#: Shingles of a slice (to twice as many), rows of a cell, shingles of a tile, shingles whose repeats are counted at once and how
#: many make one frequent, frequent shingles that all tasks get (16 bytes each), most shingles on an edge, and on all edges that are compared at once.
SPAN, CELL, TILE, COUNTED, REPEATS, FREQUENT, EDGE, WIDE = 32, 8192, 1 << 20, 1 << 22, 8, 1 << 16, 64, 1 << 21
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ODD = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def finished(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, offsets) of each slice of texts: the distinct shingles of each text, as hashes in order. A text of fewer words is one
    shingle, one without words has none.
    """
    for part in slices(plain(texts), SLICE):
        data, offsets, of = runs_of(part, SPACE)
        words, code = coded(binaries(data, offsets))
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)[code]
        ends = np.searchsorted(of, np.arange(len(part) + 1))
        size = np.diff(ends)
        count = np.where(size > 0, np.maximum(1, size - shingle + 1), 0)
        text, first = ragged(ends[:-1], count)
        total = np.full(len(first), 0x9E3779B97F4A7C15, np.uint64)
        for j in range(shingle):
            there = first + j < ends[text + 1]
            total[there] += (h[first[there] + j] + np.uint64(j + 1)) * _ODD[j]
        total = finished(total)
        order = np.lexsort((total, text))
        total, text = total[order], text[order]
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
        yield total[new], np.searchsorted(text[new], np.arange(len(part) + 1))


def digests(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A class's number: 64 bits of all its hashes."""
    view, digest = memoryview(hashes.tobytes()), xxhash.xxh3_64_intdigest
    return np.array([digest(view[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def classes(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (id, node, n): each document's class and set size; and rows (token, seen): shingles that at least REPEATS sets of some
    hundred megabytes of text hold, how many. Copies within a task are counted once.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(token: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(token), kind), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int64()), pa.array(token.view(np.int64)), pa.array(seen)], names)

        names, known, parts, kind = ["id", "node", "n", "token", "seen"], set(), [], pa.null()
        frequent = lambda: (lambda t, c: told(t[c >= REPEATS], c[c >= REPEATS]))(*np.unique(np.concatenate(parts), return_counts=True))
        for batch in batches:
            at, kind = 0, batch.column(0).type
            for hashes, offsets in shingle_sets(batch.column(1), shingle):
                size, node = np.diff(offsets), digests(hashes, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(size)), pa.array(node), pa.array(size), pa.nulls(len(size), pa.int64()), pa.nulls(len(size), pa.int64())], names)
                at += len(size)
                new = np.array([x not in known and not known.add(x) for x in node.tolist()], bool)
                parts.append(hashes[np.repeat(new, size)])
                if sum(map(len, parts)) > COUNTED:
                    yield frequent()
                    parts = []
        if parts:
            yield frequent()

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(both, f"id {kind}, node long, n long, token long, seen long")


@dataclass(frozen=True)
class Order:
    """Frequent shingles in order of their hashes, and in how many tiles their groups are cut. They come after all others."""

    tokens: np.ndarray
    tiles: np.ndarray

    def ranked(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash is of a frequent shingle, as its number, else -1."""
        if not len(self.tokens):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return np.where(self.tokens[at] == hashes, at, -1)


def level(n: np.ndarray) -> np.ndarray:
    """A set's slices: two to this power."""
    return np.maximum(0, np.floor(np.log2(np.maximum(1, n) / SPAN)).astype(np.int64))


def signatures(hashes: np.ndarray, size: np.ndarray, order: Order) -> tuple[np.ndarray, ...]:
    """(set, token, m, bits, frequent) of the sets' hashes: the first shingles of each slice, the slice's size and parity bits, and the
    frequent shingle's number or -1. A set is cut as itself and as the smallest that it can be similar to would be.
    """
    out = []
    own = level(size)
    for cut, some in ((own, np.ones(len(size), bool)), (least := level(-(-size * SHARE // OF)), least < own)):
        keep = np.repeat(some, size)
        h, text = hashes[keep], np.repeat(np.arange(len(size)), size)[keep]
        k = cut[text].astype(np.uint64)
        part = np.where(k > 0, h >> np.minimum(np.uint64(64) - k, np.uint64(63)), np.uint64(0)).astype(np.int64)
        common = order.ranked(h)
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        m = np.diff(np.append(starts, len(h)))
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (finished(h) & np.uint64(63)), starts)
        group = np.cumsum(new) - 1
        by = np.lexsort((h, common >= 0, group))
        chosen = by[np.arange(len(h)) - starts[group] < (m - -(-m * SHARE // OF) + 1)[group]]
        token = finished(h[chosen] + np.uint64(0x632BE59BD9B4E019) * (k[chosen] + np.uint64(1)))
        out.append((text[chosen], token, m[group[chosen]], bits[group[chosen]], common[chosen]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def signed(docs: DataFrame, order: Order, shingle: int) -> DataFrame:
    """(token, cell, side, node, m, bits): each class under each of its tokens, once a task. The group of a frequent shingle is cut in
    tiles, each pair of which is a cell.
    """
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for hashes, offsets in shingle_sets(batch.column(1), shingle):
                size, node = np.diff(offsets), digests(hashes, offsets)
                new = np.array([x not in known and not known.add(x) for x in node.tolist()], bool)
                of, token, m, bits, common = signatures(hashes[np.repeat(new, size)], size[new], sent.value)
                node = node[new][of]
                tiles = np.where(common >= 0, sent.value.tiles[common] if len(sent.value.tiles) else 1, 1)
                row, other = ragged(np.zeros(len(tiles), np.int64), tiles)
                own = (finished(node.view(np.uint64)) % tiles.astype(np.uint64)).astype(np.int64)[row]
                cell = np.minimum(own, other) * tiles[row] + np.maximum(own, other)
                columns = [pa.array(token[row].view(np.int64)), pa.array(cell.astype(np.int32)), pa.array((own > other).astype(np.int8)), pa.array(node[row]), pa.array(m[row].astype(np.int32)), pa.array(bits[row].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "cell", "side", "node", "m", "bits"])

    return docs.mapInArrow(sign, "token long, cell int, side byte, node long, m int, bits long")


def may_link(m: np.ndarray, bits: np.ndarray, other_m: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """Slices of sizes m that differ in no more bits than similar ones may differ in shingles."""
    most = (m.astype(np.int64) + other_m) * (OF - SHARE)
    differ = np.maximum(np.abs(m.astype(np.int64) - other_m), np.bitwise_count(bits ^ other_bits))
    return differ * (OF + SHARE) <= most


def small_cells(group: np.ndarray, m: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may link within many small groups at once; rows come group by group."""
    a, b, lag = [], [], 1
    while lag < len(group):
        i = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(i):
            break
        i = i[may_link(m[i], bits[i], m[i + lag], bits[i + lag])]
        a.append(i)
        b.append(i + lag)
        lag += 1
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def large_cell(m: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a large group, as a forest: rows that are reached already are not looked at again."""
    rest, queue, a, b = np.arange(len(m)), np.zeros(0, np.int64), [], []
    while len(rest) or len(queue):
        if not len(queue):
            queue, rest = rest[:1], rest[1:]
        some, queue = queue[:64], queue[64:]
        if not len(rest):
            break
        near = may_link(m[some, None], bits[some, None], m[None, rest], bits[None, rest])
        hit = np.flatnonzero(near.any(0))
        a.append(some[near[:, hit].argmax(0)])
        b.append(rest[hit])
        queue = np.concatenate([queue, rest[hit]])
        rest = np.delete(rest, hit)
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def by_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups, of rows that come in order of keys."""
    kept: list[pa.Table] = []
    for batch in batches:
        kept.append(pa.Table.from_batches([batch]))
        if sum(map(len, kept)) < least:
            continue
        rows = pa.concat_tables(kept).combine_chunks()
        last = rows.slice(len(rows) - 1).select(keys).to_pylist()[0]
        differs = np.logical_or.reduce([rows.column(k).to_numpy() != last[k] for k in keys])
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield rows.slice(0, cut)
        kept = [rows.slice(cut)]
    if sum(map(len, kept)):
        yield pa.concat_tables(kept).combine_chunks()


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b): a forest of classes that may belong together, cell by cell."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_groups(batches, ["token", "cell"]):
            token, cell, node, m, bits = (rows.column(c).to_numpy() for c in ("token", "cell", "node", "m", "bits"))
            bits = bits.view(np.uint64)
            new = np.ones(len(rows), bool)
            new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
            # The same class may come from several tasks.
            first = new.copy()
            first[1:] |= node[1:] != node[:-1]
            group = np.cumsum(new)[first]
            node, m, bits = node[first], m[first], bits[first]
            starts = np.flatnonzero(np.diff(group, prepend=0))
            size = np.diff(np.append(starts, len(group)))
            few = np.flatnonzero(np.repeat(size <= 64, size))
            a, b = small_cells(group[few], m[few], bits[few])
            found = [(few[a], few[b])]
            for k in np.flatnonzero(size > 64):
                whole = slice(starts[k], starts[k] + size[k])
                found.append(tuple(x + starts[k] for x in large_cell(m[whole], bits[whole])))
            a, b = (np.concatenate([x[j] for x in found]) for j in (0, 1))
            label = joined_up(len(node), a, b)
            linked = np.flatnonzero(label != np.arange(len(label)))
            pairs = np.unique(np.stack([node[linked], node[label[linked]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "token", "cell").sortWithinPartitions("token", "cell", "node").select("token", "cell", "node", "m", "bits")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


class Tree:
    """A prefix tree of sets, which come in order: edges with runs of tokens. Sets of different groups share nothing but the root.

    first, last: the sets below a node. begin, end: its edge's tokens in `tokens`. depth: tokens before the edge. parents come
    before their children, which lie side by side from kids to kids of the next node.
    """

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        self.tokens, self.offsets, self.group, self.size = tokens, offsets, group, np.diff(offsets)
        k = len(self.size)
        shared = np.full(k + 1, -1, np.int64)
        for i in range(1, k):
            if group[i] == group[i - 1]:
                a, b = tokens[offsets[i - 1] : offsets[i]], tokens[offsets[i] : offsets[i + 1]]
                n = min(len(a), len(b))
                differs = np.flatnonzero(a[:n] != b[:n])
                shared[i] = differs[0] if len(differs) else n
        # A node spans sets first to last - 1; its edge goes from depth to where a set ends, two sets part, or EDGE tokens are reached.
        begins = np.flatnonzero(shared[:-1] < 0)
        level = [(int(a), int(b), 0, -1) for a, b in zip(begins, np.append(begins[1:], k), strict=True)]
        nodes: list[tuple[int, int, int, int, int]] = []
        while level:
            below = []
            for a, b, depth, parent in level:
                upto = int(min(self.size[a], depth + EDGE, shared[a + 1 : b].min() if b - a > 1 else self.size[a]))
                me = len(nodes)
                nodes.append((a, b, depth, upto, parent))
                i = a
                while i < b and self.size[i] == upto:
                    i += 1
                while i < b:
                    j = i + 1
                    if j < b:
                        cut = np.flatnonzero(shared[j:b] <= upto)
                        j = j + int(cut[0]) if len(cut) else b
                    below.append((i, j, upto, me))
                    i = j
            level = below
        self.first, self.last, self.depth, self.upto, parent = np.array(nodes, np.int64).reshape(-1, 5).T
        self.kids = np.searchsorted(parent, np.arange(len(nodes) + 1))
        self.roots = np.flatnonzero(parent < 0)
        self.root_of = np.searchsorted(self.first[self.roots], np.arange(k), "right") - 1
        self.smallest = np.minimum.reduceat(np.append(self.size, np.iinfo(np.int64).max), np.stack([self.first, self.last], 1).ravel())[::2]
        self.largest = np.maximum.reduceat(np.append(self.size, 0), np.stack([self.first, self.last], 1).ravel())[::2]

    def spans(self, label: np.ndarray, waiting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label of the waiting sets below each node; smallest over largest where none waits."""
        at = np.stack([self.first, self.last], 1).ravel()
        low = np.minimum.reduceat(np.append(np.where(waiting, label, np.iinfo(np.int64).max), np.iinfo(np.int64).max), at)[::2]
        return low, np.maximum.reduceat(np.append(np.where(waiting, label, -1), -1), at)[::2]

    def walk(self, sets: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (set, other) of the given sets to sets below nodes that hold others than their own label."""
        row, place = ragged(self.offsets[sets], self.size[sets])
        width = int(self.tokens.max(initial=0)) + 1
        keys = row * width + self.tokens[place]
        ends = np.cumsum(self.size[sets])
        a, b = [], []
        q, node, over = np.arange(len(sets)), self.roots[self.root_of[sets]], np.zeros(len(sets), np.int64)
        while len(q):
            alive = (low[node] <= high[node]) & ~((low[node] == label[sets[q]]) & (high[node] == label[sets[q]]))
            q, node, over = q[alive], node[alive], over[alive]
            begin = self.offsets[self.first[node]] + self.depth[node]
            e, at = ragged(begin, self.upto[node] - self.depth[node])
            want = q[e] * width + self.tokens[at]
            met = np.searchsorted(keys, want)
            hit = keys[np.minimum(met, len(keys) - 1)] == want
            over = over + np.bincount(e[hit], minlength=len(q))
            # Shingles of the walking set behind the edge's last one.
            tail = np.where(self.upto[node] > 0, q * width + self.tokens[begin + self.upto[node] - self.depth[node] - 1], q * width - 1)
            remain = ends[q] - np.searchsorted(keys, tail, "right")
            x, s, g = self.size[sets[q]], self.smallest[node], self.largest[node]
            ok = ((OF + SHARE) * (over + np.minimum(remain, g - self.upto[node])) >= SHARE * (x + s)) & ((OF + SHARE) * (over + g - self.upto[node]) >= SHARE * (x + g)) & (OF * g >= SHARE * x) & (SHARE * s <= OF * x)
            q, node, over = q[ok], node[ok], over[ok]
            # Sets that end here come first below the node.
            for step in range(int((self.last[node] - self.first[node]).max(initial=0))):
                y = self.first[node] + step
                here = (y < self.last[node]) & (self.size[np.minimum(y, len(self.size) - 1)] == self.upto[node])
                if not here.any():
                    break
                y, w, o = y[here], sets[q[here]], over[here]
                link = ((OF + SHARE) * o >= SHARE * (self.size[w] + self.size[y])) & (y != w)
                a.append(w[link])
                b.append(y[link])
            e, kid = ragged(self.kids[node], self.kids[node + 1] - self.kids[node])
            q, node, over = q[e], kid, over[e]
        return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def joined(hashes: np.ndarray, offsets: np.ndarray, group: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each set (all distinct within a group) the smallest place of those that links within its group reach."""
    size = np.diff(offsets)
    # Tokens as small numbers in the order of all: frequent ones last.
    by = np.lexsort((hashes, common))
    new = np.ones(len(by), bool)
    new[1:] = hashes[by][1:] != hashes[by][:-1]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    rank = rank[np.lexsort((rank, np.repeat(np.arange(len(size)), size)))]
    text = rank.astype(">i4").tobytes()
    order = np.array(sorted(range(len(size)), key=lambda i: (group[i], text[4 * offsets[i] : 4 * offsets[i + 1]])), np.int64)
    row, place = ragged(offsets[:-1][order], size[order])
    tree = Tree(rank[place], np.concatenate([[0], np.cumsum(size[order])]), group[order])
    k = len(order)
    label, waiting = np.arange(k), np.ones(k, bool)
    members = np.bincount(tree.root_of, minlength=len(tree.roots))
    # First one set of each group walks, then ever more of them; those whose group is linked to them already need not.
    turn = np.empty(k, np.int64)
    shuffled = np.random.default_rng(0).permutation(k)
    shuffled = shuffled[np.argsort(tree.root_of[shuffled], kind="stable")]
    turn[shuffled] = np.arange(k) - np.repeat(np.cumsum(members) - members, members)
    # Shingles on a walk's widest level, at most.
    most = np.minimum(members * EDGE, np.bincount(tree.root_of, tree.size, minlength=len(members)).astype(np.int64))
    step = 1
    while waiting.any():
        low, high = tree.spans(label, waiting)
        own = tree.roots[tree.root_of]
        waiting &= ~((low[own] == high[own]) & (low[own] == label))
        sets = np.flatnonzero(waiting & (turn < step))
        cost = np.cumsum(most[tree.root_of[sets]])
        for some in np.split(sets, np.searchsorted(cost, np.arange(WIDE, cost[-1], WIDE))) if len(sets) else ():
            if len(some):
                a, b = tree.walk(some, label, low, high)
                label = joined_up(k, a, b, label)
        waiting[sets] = False
        step *= 4
    least = np.full(k, k)
    np.minimum.at(least, label, order)
    out = np.empty(k, np.int64)
    out[order] = least[label]
    return out


def tiled(live: DataFrame, tile: int = TILE) -> DataFrame:
    """live (node, id, root, n) with root, left, right: the shards a class goes to. A cluster of at most a tile is one shard; a larger one
    is cut in order of sizes, and each two tiles whose sizes are near enough are a shard.
    """
    sizes = live.groupBy("root", "n").agg((F.count("*") * F.col("n")).alias("load"))
    by = Window.partitionBy("root").orderBy("n")
    sizes = sizes.withColumn("_before", F.sum("load").over(by) - F.col("load"))
    far = by.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    sizes = sizes.withColumn("_all", F.sum("load").over(Window.partitionBy("root")))
    # A row's place among those of its size is drawn by hash.
    place = F.col("_before") + (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("load") / F.lit(1 << 30)).cast("long")
    rows = live.join(sizes, ["root", "n"]).withColumn("own", F.when(F.col("_all") <= tile, F.lit(0)).otherwise(F.floor(place / tile)).cast("int"))
    cut = written(rows.select("root", "n", "node", "id", "own"), "tiles")
    ends = cut.groupBy("root", "own").agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    other = ends.select("root", F.col("own").alias("other"), F.col("_low").alias("_o_low"), F.col("_high").alias("_o_high"))
    near = (F.col("_low") * SHARE <= F.col("_o_high") * OF) & (F.col("_o_low") * SHARE <= F.col("_high") * OF)
    # Within a cluster of one tile nothing is paired; others have as many rows here as pairs of tiles, not of classes.
    meets = ends.join(other, "root").where(near).select("root", "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
    lone = meets.groupBy("root").agg(F.max("right").alias("_most"))
    meets = meets.join(lone, "root").where("_most = 0 or left <> right").drop("_most")
    return cut.join(meets, ["root", "own"]).select("id", "node", "root", "left", "right")


def exact_links(docs: DataFrame, shards: DataFrame, order: Order, shingle: int) -> DataFrame:
    """(a, b): a forest of classes that are linked, shard by shard. The sets are made anew from the texts of one row for each class."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for hashes, offsets in shingle_sets(batch.column("_t"), shingle):
                rows, node = batch.slice(at, len(offsets) - 1), digests(hashes, offsets)
                at += len(offsets) - 1
                ok = np.flatnonzero(node == rows.column("node").to_numpy())
                sets = binaries(hashes.view(np.uint8), 8 * offsets).take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(ok)) for c in ("node", "shards")], sets], ["node", "shards", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_groups(batches, ["root", "left", "right"], 512):
            root, left, right, node = (rows.column(c).to_numpy() for c in ("root", "left", "right", "node"))
            new = np.ones(len(rows), bool)
            new[1:] = (root[1:] != root[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            group = np.cumsum(new)
            once = np.ones(len(rows), bool)
            once[1:] = new[1:] | (node[1:] != node[:-1])
            keep = np.flatnonzero(once)
            node, group = node[keep], group[keep]
            data, offsets = raw(rows.column("hashes").combine_chunks().take(pa.array(keep)))
            offsets, hashes = offsets // 8, np.ascontiguousarray(data).view(np.uint64)
            # Whole groups of some TILE shingles together.
            starts = np.flatnonzero(np.diff(group, prepend=0))
            at = 0
            while at < len(node):
                to = int(np.searchsorted(offsets[starts], offsets[at] + TILE, "right"))
                to = int(starts[to]) if to < len(starts) and starts[to] > at else len(node) if to >= len(starts) else int(np.append(starts, len(node))[to + 1])
                h = hashes[offsets[at] : offsets[to]]
                least = joined(h, offsets[at : to + 1] - offsets[at], group[at:to], sent.value.ranked(h) >= 0)
                linked = np.flatnonzero(least != np.arange(to - at))
                yield pa.RecordBatch.from_arrays([pa.array(node[at + linked]), pa.array(node[at + least[linked]])], ["a", "b"])
                at = to

    homes = shards.groupBy("id", "node").agg(F.collect_list(F.struct("root", "left", "right")).alias("shards"))
    texts = docs.join(homes, F.col("_id") == F.col("id")).select("node", "shards", "_t")
    sets = texts.mapInArrow(pack, "node long, shards array<struct<root long, left int, right int>>, hashes binary")
    rows = sets.select(F.explode("shards").alias("s"), "node", "hashes").select("s.*", "node", "hashes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "root", "left", "right").sortWithinPartitions("root", "left", "right", "node")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component) of each row: the size of its shingle set, and the smallest id that links reach from it, itself included.

    Null, empty and wordless texts have an empty set and are linked with nothing, equal ones neither. Rows with a null id are linked
    with nothing and have a null component. Each row has a row, repeated ones too. Columns besides id and text are not looked at.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("_id"), F.col(text).alias("_t"))
    known = docs.where("_id is not null")
    both = written(classes(docs, shingle), "classes")
    rows = both.where("n is not null").select("id", "node", "n")
    counts = both.where("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT).toArrow()
    tokens, seen = counts.column("token").to_numpy().view(np.uint64), counts.column("seen").to_numpy()
    by = np.argsort(tokens)
    order = Order(tokens[by], -(-seen[by] // CELL))
    reps = written(rows.where("id is not null and n > 0").groupBy("node", "n").agg(F.min("id").alias("id")), "reps")
    may = written(candidates(signed(known, order, shingle)), "may-link")
    clusters = components(may)
    live = written(reps.join(clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()), "node").select("node", "id", "n", "root"), "live")
    links = written(exact_links(known, tiled(live), order, shingle), "links")
    roots = components(links)
    rooted = reps.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = written(rooted.join(least, "root").select("node", "component"), "named")
    discard(may, live, links, reps)
    out = rows.join(named, "node", "left")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), own.alias("component"))
