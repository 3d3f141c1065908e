"""Code length of texts by prediction by partial matching over bytes, learned from the corpus.

A text is its words, each ended by a space, and a line feed at the end; letters A-Z are lowered. A byte is predicted from at
most `order` bytes before it in its text, across the spaces between words. The trie of contexts is kept as counts of grams
(context and byte) and dealt in bounded parts by the context's last three bytes, so that a context and all its suffixes of three
bytes or more are in one part; of shorter ones there are at most 2^24 counts, of six bytes each (100 MB at the most), and these
go everywhere. A part holds the trie level by level as sorted arrays, is made once, and what is asked of it streams through. Shorter contexts count contexts, not occurrences (update exclusion). Escapes are estimated by method D (half a count of each distinct symbol goes to the escape) and symbols
of longer contexts are excluded: they all occur in the shorter ones too, so what a level has left is its sum less theirs.

Beside the bytes, a word seen in training has its share of all, and the escape from whole words to bytes is the share of words seen
once; both ways to a word count (blending). This knows nothing of order, so a text's words are predicted by it and by the bytes
alone, weighted by how well each did on the words just before (switching). Each text also teaches its own, adaptive trie of the
whole words before: it is blended with what was learned, by an escape that falls from one towards a half as the text goes on. All
sum to one over words, and so does the blend.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import coded, plain, raw, slices, split, sums

#: The order is 3 at least.
ORDER, SPACE, END = 5, 0x20, 0x0A
#: The escape from a text's own words after n of them: 1 - n / (2 * (n + SETTLES)).
SETTLES = 300
#: Bytes of texts, and words, whose grams are laid out at once; grams of a part of the trie, and of the lists that are answered at once.
SLICE, WORDS, PART, ASKED = 2 << 20, 1 << 18, 500_000, 1 << 20
#: Multiplier that spreads the last three bytes of contexts over parts.
SPREAD = 0x9E3779B1
#: So many of the most frequent words, of at most so many bytes, go to all tasks (9 MB at the most) and are not asked for by chunk.
COMMON, COMMON_BYTES = 1 << 17, 64
#: How many words before a word decide between whole words and bytes, and the least weight of either.
RECENT, LEAST_WEIGHT = 32, 0.01


def lowered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    words, offsets = split(pc.ascii_lower(texts))
    return words, offsets


def with_ends(which: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words with that of the end after each text's, and the offsets of the texts in them."""
    return np.insert(which, offsets[1:], end), offsets + np.arange(len(offsets))


def word_grams(words: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams (context and byte in one number, the byte lowest) of the words laid end to end, and offsets by word. The empty word
    stands for the end of a text; the contexts of a text's first bytes are filled up with spaces.
    """
    data, offsets = raw(words.cast(pa.binary()))
    lengths = np.diff(offsets)
    first = np.concatenate([[True], lengths[:-1] == 0]) if len(lengths) else np.zeros(0, bool)
    ends = np.cumsum(lengths + 1 + order * first)
    stream = np.full(ends[-1] if len(ends) else 0, SPACE, np.uint8)
    stream[np.repeat(ends - 1 - lengths - offsets[:-1], lengths) + np.arange(len(data))] = data
    stream[ends[lengths == 0] - 1] = END
    gram = np.zeros(max(0, len(stream) - order), np.int64)
    for i in range(order + 1):
        gram <<= 8
        gram |= stream[i : len(stream) - order + i]
    to = np.concatenate([[0], np.cumsum(lengths + 1)])
    return gram[np.repeat(ends - order - to[1:], lengths + 1) + np.arange(to[-1])], to


def gram_blocks(distinct: pa.Array, which: np.ndarray, order: int, block: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and offsets by word of words given by their numbers, block by block. A block is laid out behind the words before it, as
    many as an order of bytes can reach.
    """
    for at in range(0, len(which), block):
        lead = min(at, order)
        grams, to = word_grams(distinct.take(pa.array(which[at - lead : at + block])), order)
        yield grams[to[lead] :], to[lead:] - to[lead]


def counted_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of whole texts, in order, and how often they occur."""
    words, offsets = lowered(texts)
    distinct, which = coded(words)
    which, _ = with_ends(which, offsets, len(distinct))
    distinct = pa.concat_arrays([distinct.cast(pa.binary()), pa.array([b""], pa.binary())])
    found = [np.unique(grams, return_counts=True) for grams, _ in gram_blocks(distinct, which, order)]
    return summed(np.concatenate([g for g, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)]))


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    return grams[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def found_at(sorted_: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the values are there."""
    if not len(sorted_):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(sorted_, of), len(sorted_) - 1)
    return at, sorted_[at] == of


class Level:
    """Contexts of one length: sorted grams with counts, and by context the sum of counts, the number of distinct symbols, and, of
    the next shorter context, the sum of counts of these symbols.
    """

    def __init__(self, length: int, grams: np.ndarray, counts: np.ndarray, shorter: Level | None) -> None:
        self.mask = (1 << 8 * (length + 1)) - 1
        self.grams, self.counts = summed(grams & self.mask, counts)
        context = self.grams >> 8
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        add = lambda x: np.add.reduceat(x, starts).astype(float) if len(starts) else np.zeros(0)
        self.contexts, self.total, self.distinct = context[starts], add(self.counts), add(np.ones(len(context), np.int64))
        self.below = add(shorter.counts[found_at(shorter.grams, self.grams & shorter.mask)[0]]) if shorter and len(starts) else np.zeros(len(starts))


def trie(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> list[Level]:
    """Levels from no context on. Contexts of the full order count how often a symbol followed, shorter ones in how many contexts one
    byte longer it did (update exclusion). low: grams of two bytes of context and their counts, of the whole corpus; grams: those
    of a part, complete for contexts of three bytes and more.
    """
    tables = []
    for k in range(order, -1, -1):
        if k == order:
            of, n = grams, counts
        elif k == 2:
            of, n = (x.astype(np.int64) for x in low)
        else:
            of, n = tables[-1][0] & ((1 << 8 * (k + 1)) - 1), np.ones(len(tables[-1][0]), np.int64)
        tables.append(summed(of, n))
    levels: list[Level] = []
    for k, (of, n) in enumerate(reversed(tables)):
        levels.append(Level(k, of, n, levels[-1] if levels else None))
    return levels


def predicted(needed: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each needed gram."""
    out, escaped, open_ = np.zeros(len(needed)), np.zeros(len(needed)), np.ones(len(needed), bool)
    gone_total, gone_distinct = np.zeros(len(needed)), np.zeros(len(needed))
    with np.errstate(divide="ignore", invalid="ignore"):
        for level in reversed(levels):
            at, there = found_at(level.contexts, (needed & level.mask) >> 8)
            if not there.any():
                continue
            total, distinct = level.total[at] - gone_total, level.distinct[at] - gone_distinct
            here = open_ & there & (distinct > 0)
            g, met = found_at(level.grams, needed & level.mask)
            met &= here
            out[met] = escaped[met] + np.log10(2 * level.counts[g[met]] - 1) - np.log10(2 * total[met])
            left = here & ~met
            escaped[left] += np.log10(distinct[left]) - np.log10(2 * total[left])
            open_ &= ~met
            gone_total, gone_distinct = np.where(there, level.below[at], gone_total), np.where(there, level.distinct[at], gone_distinct)
        out[open_] = escaped[open_] - np.log10(256 - gone_distinct[open_])
    return out


def times_before(which: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, by its number: how many words its text has before it, and how many of those are the same."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = text * np.int64(which.max(initial=0) + 1) + which
    order = np.argsort(key, kind="stable")
    at = np.arange(len(key))
    new = np.diff(key[order], prepend=-1) != 0
    same = np.empty(len(key), np.int64)
    same[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return at - offsets[:-1][text], same


def with_whole(escaped: np.ndarray, count: np.ndarray, n: int, once: int) -> np.ndarray:
    """log10 probability of words by their counts among n in training, of which once were seen once, and by shorter contexts."""
    if not n:
        return escaped
    escape = (once + 1) / (n + 2)
    out = escaped + math.log10(escape)
    met = np.flatnonzero(count)
    out[met] = np.logaddexp(out[met] * math.log(10), np.log((1 - escape) * count[met] / n)) / math.log(10)
    return out


def switched(whole: np.ndarray, by_bytes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of the words of texts by whole words and by bytes alone, in the weights of the text's RECENT words before."""
    lead = np.concatenate([[0.0], np.cumsum(whole - by_bytes)])
    at = np.arange(len(whole))
    lead = lead[at] - lead[np.maximum(at - RECENT, np.repeat(offsets[:-1], np.diff(offsets)))]
    weight = np.clip(1 / (1 + 10 ** np.clip(lead, -9, 9)), LEAST_WEIGHT, 1 - LEAST_WEIGHT)
    return np.logaddexp(whole * math.log(10) + np.log(1 - weight), by_bytes * math.log(10) + np.log(weight)) / math.log(10)


def blended(learned: np.ndarray, before: np.ndarray, same: np.ndarray) -> np.ndarray:
    """log10 probability of words by what was learned and by the words before in their text."""
    own = before / (2 * (before + SETTLES))
    out = learned + np.log10(1 - own)
    met = np.flatnonzero(same)
    out[met] = np.logaddexp(out[met] * math.log(10), np.log(own[met] * same[met] / before[met])) / math.log(10)
    return out


class Chances:
    """Probabilities of grams, by an open hash table: a chunk asks for one at each of its bytes."""

    def __init__(self, gram: np.ndarray, p: np.ndarray) -> None:
        self.gram, self.p = gram, p
        bits = max(4, (2 * len(gram)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(gram)), self.slot(gram)
        while len(todo):
            free = self.table[at[todo]] < 0
            self.table[at[todo[free]]] = todo[free]
            todo = todo[self.table[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & self.last

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, needed: np.ndarray) -> np.ndarray:
        """The probabilities of needed grams, all of which are there."""
        at = self.slot(needed)
        found = self.table[at]
        wrong = np.flatnonzero(self.gram[found] != needed)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            found[wrong] = self.table[at[wrong]]
            wrong = wrong[self.gram[found[wrong]] != needed[wrong]]
        return self.p[found]


def distinct_of(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs (_id, text, learns) with chunk: consecutive texts of a partition of about so many bytes, whatever ids or texts are equal."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.binary_length(plain(batch.column("text"))).to_numpy(zero_copy_only=False).astype(np.int64)
            before = held + np.cumsum(sizes) - sizes
            held += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own + before // chunk_bytes)], [*batch.schema.names, "chunk"])

    return docs.mapInArrow(number, f"_id {docs.schema['_id'].dataType.simpleString()}, text string, learns boolean, chunk long")


def part_of(gram: np.ndarray, n_parts: int) -> np.ndarray:
    return ((((gram >> 8) & 0xFFFFFF) * SPREAD & 0xFFFFFFFF) >> 8) % n_parts


def score(docs: DataFrame, learns: Column, id: str = "doc_id", text: str = "text", order: int = ORDER, chunk_bytes: int = 24 << 20, asked: int = ASKED) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text; null texts count as empty.

    learns: the rows to learn from. Tokens are words and one end per text. base_score: add-one unigrams over tokens. score:
    log10 probability by partial matching, learned and adaptive. Words and grams are counted over all rows to learn from; each chunk of texts is
    given the counts of its own words and the probabilities of its own grams, whatever the size of the whole vocabulary. Grams and
    their probabilities travel as one list for each chunk and part of the trie. Each part is made once, whatever the number of
    chunks, from its grams, which come before the lists; about `asked` grams of lists are held and answered at a time.
    """
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    rows = written(chunked(rows, chunk_bytes), "texts")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(plain(batch.column("text"))):
                words, _ = lowered(part)
                distinct, which = coded(words)
                words = pa.concat_arrays([distinct.cast(pa.binary()), pa.array([b""], pa.binary())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(np.bincount(which, minlength=len(distinct)), len(part)))], ["word", "n"])

    counts = written(rows.where("learns").select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    train_tokens, distinct_tokens, once = int(totals["n"]), int(totals["v"]), int(totals["once"])

    top = counts.where(F.octet_length("word") <= COMMON_BYTES).orderBy(F.desc("n"), "word").limit(COMMON).toArrow().combine_chunks()
    common, of_common = (top.column(c).combine_chunks() for c in ("word", "n"))
    of_common = of_common.to_numpy(zero_copy_only=False).astype(float)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for texts in slices(plain(batch.column("text")), SLICE):
                held.append(counted_grams(texts, order))
                n += len(held[-1][0])
                if n > 4 * PART:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n > 2 * PART:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["gram", "n"])
                        n = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*map(np.concatenate, zip(*held, strict=True)))], ["gram", "n"])

    grams = written(rows.where("learns").select("text").mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    longer = grams.select(F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)).alias("g")).distinct()
    got = longer.groupBy(F.col("g").bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("g")).agg(F.count("*").cast("short").alias("n")).toArrow()
    low = (got.column("g").to_numpy(), got.column("n").to_numpy())
    n_parts = int(grams.count() // PART) + 1

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(chunk: int, words: list[pa.Array], own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            distinct = pa.concat_arrays([pa.chunked_array(words, pa.string()).unique().cast(pa.binary()), pa.array([b""], pa.binary())])
            distinct = distinct.filter(pc.invert(pc.is_in(distinct, common)))
            grams = distinct_of(np.concatenate(own))
            part = part_of(grams, n_parts)
            by = np.argsort(part, kind="stable")
            grams, part = grams[by], part[by]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            lists = [grams[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(grams)), strict=True)]
            n, m = len(distinct), len(lists)
            columns = [pa.array(np.full(n + m, chunk)), pa.concat_arrays([distinct, pa.nulls(m, pa.binary())]), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(part[starts].astype(np.int32))]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(lists, pa.binary())])]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "word", "part", "grams"])

        last, words, own = None, [], []
        for batch in batches:
            chunk, texts = batch.column("chunk").to_numpy(zero_copy_only=False), plain(batch.column("text"))
            for at, to in zip((starts := np.flatnonzero(np.diff(chunk, prepend=-1))), np.append(starts[1:], len(chunk)), strict=True):
                if last is not None and chunk[at] != last:
                    yield from asked(last, words, own)
                    words, own = [], []
                last = int(chunk[at])
                for part in slices(texts.slice(at, to - at), SLICE):
                    words.append(lowered(part)[0].unique())
                    own.append(counted_grams(part, order)[0])
        if last is not None:
            yield from asked(last, words, own)

    needs = written(rows.select("chunk", "text").mapInArrow(need, "chunk long, word binary, part int, grams binary"), "needs")

    def answered(chunks: list[pa.Array], lists: list[pa.Array], levels: list[Level]) -> pa.RecordBatch:
        chunk, packed = pa.concat_arrays(chunks), pa.concat_arrays(lists)
        own = [np.frombuffer(x.as_py(), np.int64) for x in packed]
        needed = distinct_of(np.concatenate(own))
        p = predicted(needed, levels).astype(np.float32)
        return pa.RecordBatch.from_arrays([chunk, packed, pa.array([p[np.searchsorted(needed, x)].tobytes() for x in own], pa.binary())], ["chunk", "grams", "p"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, in each the grams learned before the lists asked for."""
        last, learned, levels = None, [], None
        chunks, lists, held = [], [], 0
        for batch in batches:
            part, is_list = (x.to_numpy(zero_copy_only=False) for x in (batch.column("part"), pc.is_valid(batch.column("grams"))))
            starts = np.flatnonzero(np.diff(2 * part.astype(np.int64) + is_list, prepend=-1))
            for at, to in zip(starts, np.append(starts[1:], len(part)), strict=True):
                if part[at] != last:
                    if lists:
                        yield answered(chunks, lists, levels)
                    last, learned, levels = part[at], [], None
                    chunks, lists, held = [], [], 0
                run = batch.slice(at, to - at)
                if not is_list[at]:
                    learned.append([run.column(c).to_numpy(zero_copy_only=False).copy() for c in ("gram", "n")])
                    continue
                if levels is None:
                    none = np.zeros(0, np.int64)
                    levels = trie(*(np.concatenate([none, *x]) for x in (zip(*learned, strict=True) if learned else ([], []))), low, order)
                    learned = []
                sizes = np.cumsum(pc.binary_length(run.column("grams")).to_numpy(zero_copy_only=False).astype(np.int64)) // 8
                cuts = np.flatnonzero(np.diff((held + sizes) // asked, prepend=held // asked))
                for k, (a, b) in enumerate(zip(np.append(0, cuts), np.append(cuts, to - at), strict=True)):
                    if k and lists:
                        yield answered(chunks, lists, levels)
                        chunks, lists = [], []
                    if b > a:
                        chunks.append(run.column("chunk").slice(a, b - a))
                        lists.append(run.column("grams").slice(a, b - a))
                held = int(held + sizes[-1])
        if lists:
            yield answered(chunks, lists, levels)

    tail = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))
    own_part = (F.shiftright((tail * SPREAD).bitwiseAND(F.lit(0xFFFFFFFF)), 8) % n_parts).cast("int")
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    there = grams.select(own_part.alias("part"), "gram", "n", *nothing("long", "chunk"), *nothing("binary", "grams"))
    wanted = needs.where("grams is not null").select("part", *nothing("long", "gram", "n"), "chunk", "grams")
    by_part = there.unionByName(wanted).repartition(4 * n_parts, "part").sortWithinPartitions("part", F.col("grams").isNotNull())
    chance = by_part.mapInArrow(predict, "chunk long, grams binary, p binary")
    known = needs.where("word is not null").select("chunk", "word").join(counts, "word")
    facts = known.select("chunk", "word", "n", *[F.lit(None).cast("binary").alias(c) for c in ("grams", "p")]).unionByName(chance.select("chunk", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("n"), "grams", "p"))
    names = ["_id", "n_tokens", "n_known", "base_score", "score"]

    def add_up(texts: pa.Table, facts: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (texts.schema.field("_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        is_word = pc.is_valid(facts.column("word"))
        own, lists = facts.filter(is_word), facts.filter(pc.invert(is_word))
        gram, p = (np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_py(), kind) for x in lists.column(c)]]) for c, kind in (("grams", np.int64), ("p", np.float32)))
        gram, first = np.unique(gram, return_index=True)
        chances = Chances(gram, p[first].astype(float))
        of_word = np.concatenate([own.column("n").combine_chunks().to_numpy(zero_copy_only=False).astype(float), of_common])
        own_words = pa.concat_arrays([*own.column("word").chunks, common])
        n_tokens, n_known, base, total = [], [], [], []

        for part in slices(plain(texts.column("text"))):
            words, offsets = lowered(part)
            distinct, which = coded(words)
            distinct = pa.concat_arrays([distinct.cast(pa.binary()), pa.array([b""], pa.binary())])
            which, offsets = with_ends(which, offsets, len(distinct) - 1)
            at = pc.index_in(distinct, own_words)
            count = np.where(at.is_valid().to_numpy(zero_copy_only=False), np.append(of_word, 0)[at.fill_null(len(of_word)).to_numpy(zero_copy_only=False)], 0)[which]
            by_bytes = np.concatenate([sums(chances.of(g), to) for g, to in gram_blocks(distinct, which, order)])
            learned = switched(with_whole(by_bytes, count, train_tokens, once), by_bytes, offsets)
            n = np.diff(offsets)
            n_tokens.append(n)
            n_known.append(sums((count > 0).astype(np.int64), offsets))
            base.append(sums(np.log10(count + 1), offsets) - n * math.log10(train_tokens + distinct_tokens + 1))
            total.append(sums(blended(learned, *times_before(which, offsets)), offsets))
        return pa.table([texts.column("_id"), *[pa.array(np.concatenate(x)) for x in (n_tokens, n_known, base, total)]], names=names)

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    out = rows.select("_id", "text", "chunk").groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(add_up, schema)
    return out.select(F.col("_id").alias(id), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
