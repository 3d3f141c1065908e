"""SimHash near-duplicates: links between fingerprints, and their connected components.

A fingerprint has one or more words of 64 bits. Rows are grouped by keys, some of a fingerprint's bits: with one word and a radius of
3, the bits are in five blocks, of which two fingerprints within the radius share two at least, so grouping by each pair of
blocks (some 26 bits) misses no link. A group is compared in tiles sorted by population count; pairs of tiles whose counts differ
by more than the radius are skipped. Groups larger than a tile are split over tasks, pair of tiles by pair of tiles. Equal
fingerprints are one from the start, and a group of near ones hands on a forest instead of all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, written
from .words import plain, raw, slices, split

SEED, SHINGLE, RADIUS, TILE = 42, 3, 3, 4096
#: Bytes of text, and shingles, that are worked on at once.
SLICE, BLOCK = 1 << 20, 1 << 15
PRINT = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("bits", T.IntegerType())])


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are made and compared. masks: (word, bits) of the keys by which rows meet."""

    shingle: int = SHINGLE
    words: int = 1
    radius: int = RADIUS
    masks: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def exact(shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = 5) -> Scheme:
        """One word; every pair within the radius meets, since it differs in at most radius of the blocks."""
        ends = [64 * k // blocks for k in range(blocks + 1)]
        masks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(ends)]
        return Scheme(shingle, 1, radius, tuple((0, sum(some)) for some in itertools.combinations(masks, blocks - radius)))

    @staticmethod
    def wide(shingle: int, words: int, radius: int, band: int = 16) -> Scheme:
        """Many words; a pair meets if it agrees in one of the bands of so many bits, side by side or spread evenly over a word."""
        near = [((1 << band) - 1) << at for at in range(0, 65 - band, band)]
        spread = [sum(1 << at for at in range(k, 64, 64 // band)) for k in range(64 // band)]
        return Scheme(shingle, words, radius, tuple((w, mask) for w in range(words) for mask in near + spread))


EXACT = Scheme.exact()


def hashes_of(texts: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of shingles, numbers of their texts) of texts, block by block. A text of fewer words is one shingle."""
    words, offsets = split(pc.ascii_lower(texts))
    data, ends = raw(words)
    n = len(ends) - 1
    joined = np.full(len(data) + n, 0x20, np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(ends))] = data
    sizes = np.diff(offsets)
    count = np.where(sizes > 0, np.maximum(1, sizes - shingle + 1), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(offsets[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    last = np.minimum(first + shingle, offsets[1:][text]) - 1
    low, high = ends[first] + first, ends[last + 1] + last
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, len(low), BLOCK):
        to = at + BLOCK
        yield np.array([digest(view[a:b], SEED) for a, b in zip(low[at:to].tolist(), high[at:to].tolist(), strict=True)], np.uint64), text[at:to]


def mixed(h: np.ndarray, words: int) -> np.ndarray:
    """(hash, word): the hash itself, and further words made of it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def prints(texts: pa.Array, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """(text, word): bits set in more than half of the hashes of a text's shingles; none for a text without words."""
    ones, total = np.zeros((len(texts), 64 * words), np.int64), np.zeros(len(texts), np.int64)
    for h, text in hashes_of(texts, shingle):
        # One byte a bit, eight side by side: rows of at most 255 of one text are summed without a carry.
        bits = np.unpackbits(mixed(h, words).astype(">u8").view(np.uint8)).view(np.uint64).reshape(len(h), 8 * words)
        new = np.flatnonzero(np.diff(text, prepend=-1))
        size = np.diff(np.append(new, len(text)))
        cut = -(-size // 255)
        starts = np.repeat(new, cut) + 255 * (np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut))
        part = np.add.reduceat(bits, starts, axis=0).view(np.uint8).astype(np.int64)
        np.add.at(ones, text[starts], part)
        total += np.bincount(text, minlength=len(texts))
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").astype(np.uint64)


def packed(fp: np.ndarray) -> pa.Array:
    """Fingerprints (row, word) as bytes, highest first."""
    data = fp.astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(8 * fp.shape[1]), len(fp), [None, pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array, words: int) -> np.ndarray:
    data, _ = raw(column)
    return data.view(">u8").astype(np.uint64).reshape(-1, words)


def fingerprint(text: str | Column, shingle: int = SHINGLE, words: int = 1) -> Column:
    """(fp, bits) of a whole text: its fingerprint as bytes, and how many bits are set. Letters A-Z are lowered; a null or wordless
    text has zeros.
    """

    @F.arrow_udf(PRINT)
    def both(texts: pa.Array) -> pa.Array:
        fp = np.concatenate([np.zeros((0, words), np.uint64), *[prints(part, shingle, words) for part in slices(plain(texts), SLICE)]])
        return pa.StructArray.from_arrays([packed(fp), pa.array(np.bitwise_count(fp).sum(1, dtype=np.int32))], ["fp", "bits"])

    return both.asNondeterministic()(text)


def joined_up(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member's number for each of n members that links a-b join."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ; words are the last axis."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0])
    if a.shape[-1] > 1:
        out = out.astype(np.int16)
        for k in range(1, a.shape[-1]):
            out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def block_links(fp: np.ndarray, count: np.ndarray, radius: int, left: slice, right: slice, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between two runs of rows, each in order of population count, block by block."""
    for i in range(left.start, left.stop, block):
        i_to = min(i + block, left.stop)
        for j in range(max(right.start, i if left == right else 0), right.stop, block):
            j_to = min(j + block, right.stop)
            if count[j] - count[i_to - 1] > radius or count[i] - count[j_to - 1] > radius:
                continue
            a, b = np.nonzero(differing(fp[i:i_to, None], fp[None, j:j_to]) <= radius)
            ok = a + i != b + j
            yield a[ok] + i, b[ok] + j


def cell_forest(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of members and of the member that links lead to, for all members of a cell that are linked.

    side: 0 or 1 in a cell of two tiles, of which only pairs across are compared; all 0 in a cell of its own.
    """
    count = np.bitwise_count(fp).sum(1, dtype=np.int64)
    order = np.lexsort((count, side))
    fp, count = fp[order], count[order]
    cut = int(np.searchsorted(side[order], 1))
    whole = slice(0, len(fp))
    runs = (whole, whole) if cut in (0, len(fp)) else (slice(0, cut), slice(cut, len(fp)))
    label = np.arange(len(fp))
    for a, b in block_links(fp, count, radius, *runs):
        label = joined_up(len(fp), a, b, label)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return order[linked], order[label[linked]]


def small_forests(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small groups at once; rows come group by group, in order of population count."""
    a, b, lag, count = [], [], 1, np.bitwise_count(fp).sum(1, dtype=np.int64)
    while lag < len(fp):
        i = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(i):
            break
        i = i[count[i + lag] - count[i] <= radius]
        i = i[differing(fp[i], fp[i + lag]) <= radius]
        a.append(i)
        b.append(i + lag)
        lag += 1
    label = joined_up(len(fp), np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)]))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


def keyed(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(band, value, node, fp, bits): each fingerprint of nodes (node, fp, bits) under each of its keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, bits = (batch.column(c) for c in ("node", "fp", "bits"))
            words = unpacked(fp, scheme.words)
            for k, (word, mask) in enumerate(scheme.masks):
                value = (words[:, word] & np.uint64(mask)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(value), node, fp, bits], ["band", "value", "node", "fp", "bits"])

    return nodes.select("node", "fp", "bits").mapInArrow(keys, "band int, value long, node long, fp binary, bits int")


def cells(nodes: DataFrame, scheme: Scheme = EXACT, tile: int = TILE) -> DataFrame:
    """(band, value, left, right, side, node, fp, bits): each distinct fingerprint in every cell where it has to be compared."""
    rows = keyed(nodes, scheme)
    group = Window.partitionBy("band", "value")
    all_of = written(rows.groupBy("band", "value").agg(F.count("*").alias("all")).where(F.col("all") > tile).select("band", "value"), "large-groups")
    # Only groups over a tile are counted by bits: at most 64 counts a word, whatever the group's size.
    sizes = rows.join(all_of, ["band", "value"]).groupBy("band", "value", "bits").agg(F.count("*").alias("size"))
    near = group.orderBy("bits").rangeBetween(-scheme.radius, scheme.radius)
    sizes = sizes.withColumn("before", F.sum("size").over(group.orderBy("bits")) - F.col("size"))
    sizes = sizes.withColumn("from", F.min("before").over(near)).withColumn("to", F.max(F.col("before") + F.col("size")).over(near) - 1)
    large = written(sizes.select("band", "value", "bits", "size", "before", "from", "to"), "large")
    rows = rows.join(large, ["band", "value", "bits"], "left")
    # Within its population count, a row's place in the group is drawn by hash; the tile follows from the place.
    place = F.col("before") + (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("size") / F.lit(1 << 30)).cast("long")
    rows = rows.withColumn("own", F.coalesce(F.floor(place / tile), F.lit(0)).cast("int"))
    others = F.sequence(F.coalesce(F.floor(F.col("from") / tile), F.lit(0)).cast("int"), F.coalesce(F.floor(F.col("to") / tile), F.lit(0)).cast("int"))
    rows = rows.select("band", "value", "node", "fp", "bits", "own", F.explode(others).alias("other"))
    return rows.select("band", "value", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "fp", "bits")


def links(nodes: DataFrame, scheme: Scheme = EXACT, tile: int = TILE) -> DataFrame:
    """(a, b): a forest whose trees are linked nodes (node, fp, bits), cell by cell; enough to find all components."""
    keys = ["band", "value", "left", "right"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(columns: list[np.ndarray], fp: np.ndarray) -> pa.RecordBatch:
            band, value, left, right, side, node = columns
            new = np.ones(len(fp), bool)
            new[1:] = (np.diff(band) != 0) | (np.diff(value) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)
            starts = np.append(np.flatnonzero(new), len(fp))
            size = np.diff(starts)
            few = np.repeat(size <= 64, size)
            found = [tuple(np.flatnonzero(few)[x] for x in small_forests(fp[few], np.repeat(np.arange(len(size)), size)[few], scheme.radius))]
            found += [tuple(x + starts[k] for x in cell_forest(fp[starts[k] : starts[k + 1]], side[starts[k] : starts[k + 1]], scheme.radius)) for k in np.flatnonzero(size > 64)]
            a, b = (node[np.concatenate([x[k] for x in found])] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        kept: tuple[list[np.ndarray], np.ndarray] | None = None
        for batch in batches:
            columns, fp = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side", "node")], unpacked(batch.column("fp"), scheme.words)
            if kept is not None:
                columns, fp = [np.concatenate(x) for x in zip(kept[0], columns, strict=True)], np.concatenate([kept[1], fp])
            if not len(fp):
                continue
            differs = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns[:4]]))
            cut = differs[-1] + 1 if len(differs) else 0
            kept = [c[cut:] for c in columns], fp[cut:]
            if cut:
                yield groups([c[:cut] for c in columns], fp[:cut])
        if kept is not None and len(kept[1]):
            yield groups(*kept)

    rows = cells(nodes, scheme, tile)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys, "bits")
    return dealt.select(*keys, "side", "node", "fp").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): large and small stars in turn until nothing moves, however many rounds it takes.

    Each half round is written down, so that a lost executor costs no more than that.
    """
    star = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star")
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
    before, now = None, state(star)
    while now != before:
        both = star.union(star.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, star = star, written(small, "star")
        before, now = now, state(star)
        discard(last, large)
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", scheme: Scheme = EXACT) -> DataFrame:
    """(id, fp, component) of each row: its fingerprint, and the smallest id that links of at most radius differing bits reach
    from it, itself included. Null ids count for nothing; a component of them alone has a null component.
    """
    made = docs.select(F.col(id).alias("_id"), fingerprint(F.col(text), scheme.shingle, scheme.words).alias("_p")).select("_id", "_p.fp", "_p.bits")
    rows = written(made, "fingerprints")
    nodes = written(rows.groupBy("fp", "bits").agg(F.min("_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    parts = components(links(nodes, scheme))
    rooted = written(nodes.join(parts, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = written(rooted.join(least, "root").select("fp", "component"), "classes")
    return rows.join(classes, "fp").select(F.col("_id").alias(id), "fp", "component")
