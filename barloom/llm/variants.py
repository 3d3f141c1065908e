"""Spelling variants: words at one insertion, deletion or replacement from each other, grouped under their most frequent form.

The counted words, in order, are cut into shards of a bounded number of words, each a compact trie in flat arrays. The shards are
sent to all tasks, some at a time; each word's automaton of distance one is intersected with every shard. Blocks of words go
down a trie side by side in numpy, from a stack, deepest first, so that memory stays bounded. A task hands on, of each word and
shard, the number of neighbours and the best one; these are reduced by word.

All characters of words are below U+0100, so a word is kept as one byte a character.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written
from .words import binaries, plain, ragged, runs_of, slices

SLICE, COUNTED = 4 << 20, 1 << 20
#: Words and bytes of a shard (a longer word has one of its own), shards sent at once, words and states that go down side by side.
SHARD, SHARD_BYTES, AT_ONCE, SIDE, STATES = 1 << 16, 1 << 20, 8, 1 << 12, 1 << 18
#: ASCII letters, and the first byte of U+00C0 to U+00FF.
LEAD = 0xC3
INSIDE = np.zeros(256, bool)
INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[LEAD] = True


def changed(word: bytes, h: int) -> bytes:
    """The word without the character at place h modulo its length."""
    x = word.decode()
    at = h % len(x)
    return (x[:at] + x[at + 1 :]).encode()


def counted(texts: pa.Array, ids: list, least: int, modulus: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words, counts) of texts, slice by slice; every modulus-th run of a document, by hash, loses a character."""
    at, crc = 0, zlib.crc32
    for part in slices(texts, SLICE):
        data, offsets, text = runs_of(part, INSIDE, LEAD)
        length = np.diff(np.concatenate([[0], np.cumsum(data >> 6 != 2)])[offsets])
        long = np.flatnonzero(length >= least)
        runs = binaries(data, offsets).take(pa.array(long)).dictionary_encode()
        words, code, text = runs.dictionary.to_pylist(), runs.indices.to_numpy(zero_copy_only=False), text[long]
        seed = np.array([crc(f"{x}:".encode()) for x in ids[at : at + len(part)]], np.int64)
        at += len(part)
        h = np.fromiter((crc(words[c], s) for c, s in zip(code.tolist(), seed[text].tolist(), strict=True)), np.int64, len(code))
        hit = h % modulus == 0
        n = np.bincount(code[~hit], minlength=len(words))
        yield runs.dictionary.take(pa.array(np.flatnonzero(n))), n[n > 0]
        new = [x for c, k in zip(code[hit].tolist(), h[hit].tolist(), strict=True) if len((x := changed(words[c], k)).decode()) >= least]
        yield pa.array(new, pa.binary()), np.ones(len(new), np.int64)


def word_counts(docs: DataFrame, id: str, text: str, least: int, modulus: int) -> DataFrame:
    """(word, n): all words of at least so many characters. Null texts have none; a null id counts as an empty text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        merged = lambda: pa.concat_tables(kept).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()
        for batch in batches:
            for words, n in counted(plain(batch.column(1)), batch.column(0).to_pylist(), least, modulus):
                kept.append(pa.table([words, pa.array(n, pa.int64())], names=["word", "n"]))
                if sum(map(len, kept)) > 2 * COUNTED:
                    kept = [merged()]
                    if len(kept[0]) > COUNTED:
                        yield from kept.pop().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
        if kept:
            yield from merged().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()

    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_id"), F.col(text).alias("_t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Words:
    """Words as one byte a character, end to end."""

    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Words:
        return Words(np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Characters at places of words; -1 behind the end."""
        ok = place < self.sizes[word]
        out = np.full(len(word), -1, np.int64)
        out[ok] = self.data[self.offsets[word[ok]] + place[ok]]
        return out

    def text(self, k: int) -> str:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes().decode("latin-1")


@dataclass(frozen=True)
class Trie:
    """Nodes level by level: label, first child (children lie side by side, by label), and the word that ends there or -1."""

    labels: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    words: Words
    n: np.ndarray

    @staticmethod
    def of(words: list[str], n: np.ndarray) -> Trie:
        """From words in order."""
        w = Words.of(words)
        node, labels, parents, ends = np.zeros(len(words), np.int64), [np.zeros(1, np.uint8)], [np.full(1, -1)], [np.full(1, -1)]
        depth, base, alive = 0, 1, np.arange(len(words))
        while len(alive):
            c = w.data[w.offsets[alive] + depth]
            key = node[alive] * 256 + c
            new = np.append(True, key[1:] != key[:-1])
            node[alive] = base + np.cumsum(new) - 1
            labels.append(c[new])
            parents.append(key[new] // 256)
            end = np.full(int(new.sum()), -1)
            over = w.sizes[alive] == depth + 1
            end[node[alive[over]] - base] = alive[over]
            ends.append(end)
            base, depth, alive = base + len(end), depth + 1, alive[~over]
        parent = np.concatenate(parents)
        return Trie(np.concatenate(labels), np.searchsorted(parent, np.arange(base + 1)).astype(np.int32), np.concatenate(ends).astype(np.int32), w, n)

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child by a label, or -1. Children are in order, so one search over (parent, label) finds it."""
        low, high = self.first[node].astype(np.int64), self.first[node + 1].astype(np.int64)
        out = np.full(len(node), -1, np.int64)
        while len(open := np.flatnonzero(low < high)):
            mid = (low[open] + high[open]) // 2
            c = self.labels[mid].astype(np.int64)
            out[open[c == label[open]]] = mid[c == label[open]]
            low[open] = np.where(c < label[open], mid + 1, low[open])
            high[open] = np.where(c < label[open], high[open], np.where(c == label[open], low[open], mid))
        return out

    def neighbours(self, words: Words, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, own word) of all pairs at distance one, for the words from begin to end.

        A state is (word, node, place in the word, whether the edit is spent). Before the edit all children are entered: on the
        word's character without an edit, by a replacement, an insertion, or behind a deleted character; after it only the one
        on the word's character.
        """
        size, found = words.sizes, []
        stack = [(np.arange(begin, end), np.zeros(end - begin, np.int64), np.zeros(end - begin, np.int64), np.zeros(end - begin, bool))]
        while stack:
            state = stack.pop()
            if len(state[0]) > STATES:
                half = len(state[0]) // 2
                stack += [tuple(x[half:] for x in state), tuple(x[:half] for x in state)]
                continue
            w, node, i, spent = state
            s = np.flatnonzero(spent & (i < size[w]))
            to = self.child(node[s], words.at(w[s], i[s]))
            s, to = s[to >= 0], to[to >= 0]
            steps = [(w[s], to, i[s] + 1, np.ones(len(s), bool))]
            f = np.flatnonzero(~spent)
            row, to = ragged(self.first[node[f]].astype(np.int64), (self.first[node[f] + 1] - self.first[node[f]]).astype(np.int64))
            wf, at, label = w[f][row], i[f][row], self.labels[to].astype(np.int64)
            own = words.at(wf, at)
            for ok, move, edit in ((label == own, 1, False), ((label != own) & (own >= 0), 1, True), (np.ones(len(to), bool), 0, True), (label == words.at(wf, at + 1), 2, True)):
                steps.append((wf[ok], to[ok], at[ok] + move, np.full(int(ok.sum()), edit)))
            w, node, i, spent = (np.concatenate(x) for x in zip(*steps, strict=True))
            over = self.ends[node]
            hit = (over >= 0) & np.where(spent, i == size[w], i == size[w] - 1)
            found.append(w[hit] * len(self.n) + over[hit])
            on = self.first[node + 1] > self.first[node]
            if on.any():
                stack.append((w[on], node[on], i[on], spent[on]))
        pair = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return pair // max(1, len(self.n)), pair % max(1, len(self.n))


def shards(words: DataFrame) -> DataFrame:
    """(words, n) of each shard of words (word, n): lists in order, of a bounded number of words and bytes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda w, n: pa.RecordBatch.from_arrays([pa.array([w], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64()))], ["words", "n"])
        w, n, size = [], [], 0
        for batch in batches:
            for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w and (len(w) >= SHARD or size + len(word) > SHARD_BYTES):
                    yield row(w, n)
                    w, n, size = [], [], 0
                w.append(word)
                n.append(k)
                size += len(word)
        if w:
            yield row(w, n)

    count = max(1, -(-words.count() // SHARD))
    return words.select("word", "n").repartitionByRange(count, "word").sortWithinPartitions("word").mapInArrow(deal, "words array<string>, n array<long>")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many words of the table (word, n) are at distance one, and the most frequent of them, ties by
    order of characters; words without any are left out.
    """
    sc, parts, out = words.sparkSession.sparkContext, written(shards(words), "shards"), []
    for some in batched(parts.toLocalIterator(), AT_ONCE):
        sent = sc.broadcast([Trie.of(r["words"], np.array(r["n"], np.int64)) for r in some])

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = Words.of(batch.column(0).to_pylist())
                for trie in sent.value:
                    for begin in range(0, batch.num_rows, SIDE):
                        w, own = trie.neighbours(words, begin, min(begin + SIDE, batch.num_rows))
                        order = np.lexsort((own, -trie.n[own], w))
                        w, own = w[order], own[order]
                        first = np.flatnonzero(np.diff(w, prepend=-1))
                        best = own[first]
                        columns = [batch.column(0).take(pa.array(w[first])), pa.array(np.diff(np.append(first, len(w)))), pa.array([trie.words.text(k) for k in best.tolist()], pa.string()), pa.array(trie.n[best])]
                        yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near", "near_n"])

        out.append(written(words.select("word").mapInArrow(look, "word string, n_near long, near string, near_n long"), "near"))
        sent.destroy()
    discard(parts)
    if not out:
        return words.sparkSession.createDataFrame([], "word string, n_near long, near string, near_n long")
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    best = F.min(F.struct((-F.col("near_n")).alias("_m"), F.col("near").alias("_w")))
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b._w").alias("near"), (-F.col("_b._m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to. A form's count is a multiple of its word's, so there are no circles;
    each round doubles the steps.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = written(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(now)
        now = new.drop("_moved")
        now.written_at = new.written_at
        if not new.where("_moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 6, occurrences: int = 5, ratio: int = 5, modulus: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least `least` characters with so many occurrences.

    Words are runs of ASCII letters and U+00C0 to U+00FF with A-Z lowered; every modulus-th run of a document, by hash, loses a
    character. form is the most frequent word at distance one, ties by order of characters, if it occurs at least ratio times as
    often, else null; root follows forms to the last. Null texts have no words, a null id counts as an empty text in the hash;
    repeated rows count each. Other columns are not looked at. An empty table gives an empty result.
    """
    words = written(word_counts(docs, id, text, least, modulus).where(F.col("n") >= occurrences), "words")
    near = near_words(words)
    forms = words.join(near, "word", "left").withColumn("_is", F.col("near_n") >= ratio * F.col("n"))
    forms = written(forms.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), F.col("near")).alias("form"), F.when(F.col("_is"), F.col("near_n")).alias("form_n")), "forms")
    last = roots(forms.where("form is not null"))
    return forms.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
