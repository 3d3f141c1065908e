"""Exact removal of repeated 200-byte strings with sharded suffix arrays.

Only strings that share their smallest hash can be equal, so the texts are cut once in runs of windows with one smallest hash
(windows.runs), kept by place. Runs whose hash occurs nowhere else go. Runs that occur twice or more as a whole repeat as a whole
and are sent on once. What is left is brought together by that hash in shards of bounded size; each shard has a suffix array,
refined by doubling (Larsson and Sadakane), and common prefixes of neighbours in it (Kasai), which say what windows are equal. A
hash with more runs than a shard holds has many shards: each hands on its distinct windows, packed by buckets of their digests, and
what two shards have in common is found bucket by bucket, by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as X
from .shared import discard, written
from .words import plain, raw, slices

WINDOW, SHARD, BUCKETS = 200, 1024, 1 << 14
#: Bytes of text, and of shards, that are worked on at once; longer texts are read in pieces that overlap by a window.
PIECE = 1 << 20
#: A distinct window of a shard: digest, run, and its place in the run, or -1 if the shard has settled it.
ENTRY = np.dtype([("d", "S16"), ("r", "<i8"), ("place", "<i4")])


def refined(rank: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One doubling: positions in groups of equal rank are ordered by other as well. A rank is the place of its group's first member
    in the order of all; groups of one stay as they are, which is what makes later steps cheap.
    """
    open_ = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
    if not len(open_):
        return rank
    key = rank[open_] * np.int64(2 * len(rank)) + other[open_]
    order = np.argsort(key)
    key, open_ = key[order], open_[order]
    group_starts = np.flatnonzero(np.diff(rank[open_], prepend=-1))
    within = np.arange(len(open_)) - np.repeat(group_starts, np.diff(np.append(group_starts, len(open_))))
    new = np.diff(key, prepend=-1) != 0
    first = np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))
    out = rank.copy()
    out[open_] = rank[open_] + within[first]
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first byte highest; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i : i + len(data)]
    return key


def suffix_array(key: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, from the eight bytes from each position on. A suffix that ends comes first."""
    n = len(key)
    order = np.argsort(key)
    ordered = key[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    rank, width = np.empty(n, np.int64), min(8, n)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        finer = refined(rank, np.concatenate([rank[width:] + width, np.arange(width)[::-1]]))
        if finer is rank:
            break
        rank, width = finer, min(2 * width, n)
    order[rank] = np.arange(n)
    return order


def common_prefixes(key: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """By place in the order, the bytes in common with the suffix before, most at the most.

    As Kasai's loop does, a position starts from what one before it in the text found, less the step between them; here every 64th
    position comes first, then every 8th, then all, each level side by side, eight bytes at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int64)
    for stride, above in ((64, 0), (8, 64), (1, 8)):
        at = np.arange(0, n, stride)
        if above:
            at = at[at % above != 0]
            common[at] = np.maximum(common[at - at % above] - at % above, 0)
        at = at[before[at] >= 0]
        left = n - np.maximum(at, before[at])
        going = common[at] < np.minimum(most, left)
        at, left = at[going], left[going]
        while len(at):
            done = common[at]
            differs = key[at + done] ^ key[before[at] + done]
            same = np.full(len(at), 8)
            some = differs != 0
            high = differs[some].byteswap()
            same[some] = np.bitwise_count((high & (~high + np.uint64(1))) - np.uint64(1)) // 8
            common[at] = np.minimum(done + same, left)
            going = (same == 8) & (common[at] < np.minimum(most, left))
            at, left = at[going], left[going]
    return np.minimum(common, most)[order]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, whether it repeats, whether it leads its class) of each window inside the strings that lie end to end in data.
    Suffixes that begin with the same window are neighbours with as much in common; those too near their string's end do not count.
    """
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    inside = left >= window
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    key = eights(data)
    order = suffix_array(key)
    of_class = np.cumsum(common_prefixes(key, order, window) < window)
    ok = inside[order]
    at, of_class = order[ok], of_class[ok]
    again = np.bincount(of_class)[of_class] > 1
    leads = np.diff(of_class, prepend=-1) != 0
    by = np.argsort(at)
    return at[by], again[by], leads[by]


def parts_of(texts: pa.Array, window: int, piece: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(number of the first text, bytes, offsets, where in its text the first byte is) of slices of texts. A text over two pieces
    comes in pieces of its own, each with the first bytes of the next, so that each window is in one of them.
    """
    at = 0
    for part in slices(plain(texts), piece):
        data, offsets = raw(part)
        if len(part) == 1 and len(data) > 2 * piece:
            for start in range(0, len(data) - window + 1, piece):
                own = data[start : start + piece + window - 1]
                yield at, own, np.array([0, len(own)]), start
        else:
            yield at, data, offsets, 0
        at += len(part)


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    c = table.column(name)
    return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False)


def all_runs(rows: DataFrame, window: int, piece: int) -> DataFrame:
    """(row, first, last, h, r, again) of every run of windows of the texts: where in its text its windows start, their smallest
    hash, the digest of all bytes they cover, and whether a window may occur twice within the run.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = column(batch, "_row")
            for at, data, offsets, start in parts_of(batch.column("_text"), window, piece):
                h, first, last, again = X.runs(data, offsets, window, again=True)
                r = X.region_digests(data.tobytes(), first, last, window)
                text = np.searchsorted(offsets, first, "right") - 1
                own = start - offsets[text]
                places = [pa.array((x + own).astype(np.int32)) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(row[at + text]), *places, pa.array(h.view(np.int64)), pa.array(r), pa.array(again)], ["_row", "first", "last", "h", "r", "again"])

    return rows.select("_row", "_text").mapInArrow(scan, "_row long, first int, last int, h long, r long, again boolean")


def regions_of(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(h, shard, shards, r, region): the bytes of the wanted runs (_row, first, last, h, shard, shards, r). A row's list is as long
    as its text at most.
    """
    lists = wanted.groupBy("_row").agg(F.collect_list(F.struct("h", "shard", "shards", "r", "first", "last")).alias("_wanted"))
    each = rows.select("_row", F.col("_text").cast("binary").alias("_bytes")).join(lists, "_row").select("_bytes", F.explode("_wanted").alias("w"))
    region = F.substring("_bytes", F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + window)
    return each.select("w.h", "w.shard", "w.shards", "w.r", region.alias("region"))


def matched(regions: DataFrame, window: int, piece: int) -> DataFrame:
    """(h, r, first, last) of ranges of repeated windows by their offsets in their run; and for hashes of more than one shard
    (h, bucket, packed): the shard's distinct windows as packed entries, dealt over as many buckets as there are shards.
    """
    schema = pa.schema([("h", pa.int64()), ("r", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        h, r, shards, regions = zip(*rows, strict=True)
        blob = b"".join(regions)
        data, offsets = np.frombuffer(blob, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in regions])])
        at, again, leads = repeated_windows(data, offsets, window)
        own = np.searchsorted(offsets, at, "right") - 1
        place = at - offsets[own]
        hit = np.flatnonzero(again)
        cut = np.flatnonzero((np.diff(own[hit], prepend=-1) != 0) | (np.diff(place[hit], prepend=-9) != 1))
        ends = np.append(cut[1:], len(hit)) - 1 if len(cut) else cut
        h, r, shards = np.array(h, np.int64), np.array(r, np.int64), np.array(shards, np.int64)
        which = own[hit[cut]]
        none = [None] * len(which)
        out = [[*h[which].tolist()], [*r[which].tolist()], [*place[hit[cut]].tolist()], [*place[hit[ends]].tolist()], none, [*none]]
        more = np.flatnonzero(leads & (shards[own] > 1))
        if len(more):
            entries = np.zeros(len(more), ENTRY)
            digests = [hashlib.blake2b(blob[a : a + window], digest_size=16).digest() for a in at[more].tolist()]
            entries["d"], entries["r"], entries["place"] = digests, r[own[more]], np.where(again[more], -1, place[more])
            bucket = np.frombuffer(b"".join(digests), "<u8")[::2] % np.minimum(shards[own[more]], BUCKETS).astype(np.uint64)
            order = np.lexsort((bucket, h[own[more]]))
            keys = np.stack([h[own[more]][order], bucket[order].astype(np.int64)])
            starts = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(0)))
            for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                for column, x in zip(out, (int(keys[0, a]), None, None, None, int(keys[1, a]), entries[order[a:b]].tobytes()), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, schema, strict=True)], schema=schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, last = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("h", "shard", "r", "shards", "region")], strict=True):
                if held > piece and row[:2] != last:
                    yield settle(waiting)
                    waiting, held = [], 0
                last = row[:2]
                waiting.append((row[0], row[2], row[3], row[4]))
                held += len(row[4])
        if waiting:
            yield settle(waiting)

    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = regions.repartition(n, "h", "shard").sortWithinPartitions("h", "shard")
    return dealt.select("h", "shard", "r", "shards", "region").mapInArrow(match, "h long, r long, first int, last int, bucket int, packed binary")


def merged(packed: DataFrame) -> DataFrame:
    """(h, r, first, last): windows that are single in their shard and occur in another of the same hash. All shards' entries of a
    bucket are sorted, and each open one looks for its equals by binary search.
    """
    schema = pa.schema([("h", pa.int64()), ("r", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def merge(rows: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(x, ENTRY) for x in rows.column("packed").to_pylist()])
        ordered = np.sort(entries["d"])
        single = entries[entries["place"] >= 0]
        found = single[np.searchsorted(ordered, single["d"], "right") - np.searchsorted(ordered, single["d"], "left") > 1]
        h = np.full(len(found), rows.column("h")[0].as_py(), np.int64)
        return pa.table([h, found["r"], found["place"], found["place"]], schema=schema)

    return packed.groupBy("h", "bucket").applyInArrow(merge, "h long, r long, first int, last int")


def removed(text: np.ndarray, first: np.ndarray, last: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of the maximal runs of bytes that windows starting from first to last cover, in n texts."""
    order = np.lexsort((first, text))
    text, first, end = text[order], first[order].astype(np.int64), last[order].astype(np.int64) + window
    far = np.int64(1) << 40  # texts are told apart by distance
    reach = np.maximum.accumulate(end + text * far)
    new = np.append(True, first[1:] + text[1:] * far > reach[:-1])[: len(text)]
    starts = np.flatnonzero(new)
    to = reach[np.append(starts[1:], len(text)) - 1] - text[starts] * far if len(starts) else np.zeros(0, np.int64)
    return text[starts], first[starts], to


def cleaned(rows: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """Each text without the bytes that the windows of its hits (_row, first, last) cover."""
    kind = rows.schema["_id"].dataType.simpleString()
    spans = hits.groupBy("_row").agg(F.collect_list(F.struct("first", "last")).alias("_hits"))
    out_schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("_text"), batch.column("_hits")
            at = 0
            for part in slices(plain(texts), PIECE):
                lists = found.slice(at, len(part))
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                text, low, high = removed(np.repeat(np.arange(len(part)), sizes), *[flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last")], len(part), window)
                data, offsets = raw(part)
                n_removed = np.bincount(text, high - low, len(part)).astype(np.int64)
                n_spans = np.bincount(text, minlength=len(part)).astype(np.int64)
                view, kept, k = memoryview(data), [], 0
                low, high = (low + offsets[text]).tolist(), (high + offsets[text]).tolist()
                for n, a, b in zip(n_spans.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = []
                    for x in range(k, k + n):
                        own.append(view[a : low[x]])
                        a = high[x]
                    kept.append(b"".join([*own, view[a:b]]))
                    k += n
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, len(part)), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.binary())], ["_id", "n_bytes", "n_removed", "n_spans", "kept"])
                at += len(part)

    return rows.join(spans, "_row", "left").select("_id", "_text", "_hits").mapInArrow(clean, out_schema)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row: its UTF-8 bytes without those covered by a window that also starts
    anywhere else, in this text or another. Windows are judged on the input. A null text counts as empty; rows that share an id
    are rows of their own, and repeat each other.
    """
    rows = written(docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row")), "texts")
    each = written(all_runs(rows, window, piece), "runs")
    shared = each.groupBy("h").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("h")
    runs = written(each.join(shared, "h"), "shared-runs")
    discard(each)
    regions = written(runs.groupBy("h", "r").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("_row", "first", "last")).alias("at")), "regions")
    hashes = regions.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("again").alias("again")).where("(k > 1 or again) and least = 1").select("h", F.ceil(F.col("k") / shard).cast("int").alias("shards"))
    wanted = regions.join(hashes, "h").withColumn("shard", F.pmod(F.xxhash64("r"), F.col("shards")).cast("int"))
    wanted = written(wanted.select("h", "r", "n", "shard", "shards", "at.*"), "wanted")
    found = written(matched(regions_of(rows, wanted, window), window, piece), "matched")
    across = merged(found.where("packed is not null").select("h", "bucket", "packed"))
    partly = found.where("packed is null").select("h", "r", F.col("first").alias("a"), F.col("last").alias("b")).unionByName(across.select("h", "r", F.col("first").alias("a"), F.col("last").alias("b")))
    partly = wanted.where("n = 1").select("h", "r", "_row", "first").join(partly, ["h", "r"]).select("_row", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last"))
    wholly = runs.join(regions.where("n > 1").select("h", "r"), ["h", "r"]).select("_row", "first", "last")
    return cleaned(rows, wholly.unionByName(partly), window).withColumnRenamed("_id", id)
