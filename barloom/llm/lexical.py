"""Ranked lexical search: the best documents of each item by a weight that saturates with a term's frequency, in whole numbers.

A threshold-seeded join. The texts are read once, into an index that holds, of each document, its length and the terms that occur
in items. From that come the documents' frequencies, and for each term its best and its kth best impact. An item's kth score is
at least the largest kth impact of its terms: that seeds its threshold. Terms, weakest first, whose best impacts sum to less
cannot bring a document in by themselves, so candidates are the documents with one of the other terms whose partial score and
the rest's bound reach the threshold; they are scored exactly. Within a task a threshold rises with the scores found.

Items come in blocks of a bounded number of terms, which all tasks get; documents stay where they are. What is shuffled is
k rows for each item, and for each term, of each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written
from .words import binaries, plain, ragged, runs_of, slices

SLICE, EXPANDED = 4 << 20, 1 << 21
#: Rows (item, term) of a block of items: some 40 bytes each, in every task. A single item may have more.
BLOCK = 1 << 17
#: Letters and digits of ASCII, and all bytes of other characters.
INSIDE = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    INSIDE[_a:_b] = True


def terms_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int, int]]:
    """(distinct terms, term of each occurrence, its text, first text, number of texts), slice by slice."""
    at = 0
    for part in slices(plain(texts), SLICE):
        data, offsets, text = runs_of(part, INSIDE)
        coded = binaries(data, offsets).dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), text, at, len(part)
        at += len(part)


def item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, term, q): how often each term occurs in an item. Rows of one id are one item; equal rows count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, code, of, at, _ in terms_of(batch.column(1)):
                key, q = np.unique(of * max(1, len(names)) + code, return_counts=True)
                item = batch.column(0).take(pa.array(at + key // max(1, len(names))))
                yield pa.RecordBatch.from_arrays([item, names.take(pa.array(key % max(1, len(names)))), pa.array(q)], ["item", "term", "q"])

    rows = items.select(F.col(id).alias("item"), F.col(text).alias("_t")).distinct()
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(count, f"item {kind}, term binary, q long").groupBy("item", "term").agg(F.sum("q").alias("q"))


def forward_index(docs: DataFrame, id: str, text: str, terms: pa.Array) -> DataFrame:
    """(id, n, terms, tfs) of each document with a term: how many it has, and which of the given ones, by number, how often."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, code, of, at, size in terms_of(batch.column(1)):
                n = np.bincount(of, minlength=size)
                number = pc.fill_null(pc.index_in(names, value_set=known.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                of, number = of[number[code] >= 0], number[code][number[code] >= 0]
                key, tf = np.unique(of * max(1, len(known.value)) + number, return_counts=True)
                there = np.flatnonzero(n)
                offsets = np.searchsorted(key, np.append(there, size) * max(1, len(known.value))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (key % max(1, len(known.value)), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + there)), pa.array(n[there]), *lists], ["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("_t"))
    return rows.mapInArrow(index, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


@dataclass(frozen=True)
class Corpus:
    """What scores need besides a document: its number, all terms, and each term's weight."""

    documents: int
    total: int
    weights: np.ndarray

    def postings(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, impact) of rows of the index, in order of documents and terms."""
        n, terms, tfs = (batch.column(c) for c in ("n", "terms", "tfs"))
        doc = np.repeat(np.arange(len(n)), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        m = 100 - 75 + 75 * n.to_numpy(zero_copy_only=False).astype(np.int64) * self.documents // max(1, self.total)
        return doc, term, self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))


def first_of_each(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each group."""
    order = np.lexsort((-value, group))
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < k]


def term_seeds(index: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """(term, best, kth): its largest impact and its kth largest, 0 if fewer documents have it."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, t, i = corpus.postings(batch)
            term, impact = np.concatenate([term, t]), np.concatenate([impact, i])
            kept = first_of_each(term, impact, k)
            term, impact = term[kept], impact[kept]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(impact)], ["term", "impact"])

    rows = index.select("id", "n", "terms", "tfs").mapInArrow(largest, "term long, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    return rows.withColumn("place", place).where(F.col("place") <= k).groupBy("term").agg(F.max("impact").alias("best"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))


@dataclass(frozen=True)
class Seeded:
    """Items of a block with their terms, weakest first: sizes by offsets; bounds are the most that a term can add."""

    offsets: np.ndarray
    terms: np.ndarray
    q: np.ndarray
    bounds: np.ndarray
    least: np.ndarray

    @staticmethod
    def of(item: np.ndarray, term: np.ndarray, q: np.ndarray, best: np.ndarray, kth: np.ndarray, n_items: int) -> Seeded:
        order = np.lexsort((term, q * best[term], item))
        item, term, q = item[order], term[order], q[order]
        least = np.zeros(n_items, np.int64)
        np.maximum.at(least, item, q * kth[term])
        return Seeded(np.searchsorted(item, np.arange(n_items + 1)), term, q, q * best[term], least)

    def cut(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each item, how many of its weakest terms do not reach its threshold even together, and what they can add at most."""
        upto = np.concatenate([[0], np.cumsum(self.bounds)])
        begin = upto[self.offsets[:-1]]
        weak = np.clip(np.searchsorted(upto, begin + np.maximum(least, 1), "left") - 1, self.offsets[:-1], self.offsets[1:]) - self.offsets[:-1]
        return weak, upto[self.offsets[:-1] + weak] - begin


def best_of(found: pa.Table, k: int) -> pa.Table:
    """The k best rows (item, score, id) of each item; equal scores by ascending id, null last."""
    found = found.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
    item = found.column("item").to_numpy()
    new = np.flatnonzero(np.diff(item, prepend=-1))
    return found.filter(pa.array(np.arange(len(item)) - np.repeat(new, np.diff(np.append(new, len(item)))) < k))


def scored(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, items: Seeded, least: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, score) of all documents that reach an item's threshold, which is 1 at least."""
    n_items = len(items.least)
    weak, rest = items.cut(least)
    row, place = ragged(items.offsets[:-1] + weak, np.diff(items.offsets) - weak)
    order = np.argsort(items.terms[place], kind="stable")
    of, row, place = items.terms[place][order], row[order], place[order]
    low, high = np.searchsorted(of, term), np.searchsorted(of, term, "right")
    p, at = ragged(low, high - low)
    pair, where = np.unique(doc[p] * n_items + row[at], return_inverse=True)
    score = np.zeros(len(pair), np.int64)
    np.add.at(score, where, items.q[place[at]] * impact[p])
    reach = np.maximum(least, 1)
    ok = score + rest[pair % n_items] >= reach[pair % n_items]
    pair, score = pair[ok], score[ok]
    d, i = pair // n_items, pair % n_items
    c, at = ragged(items.offsets[:-1][i], weak[i])
    key, want = doc * n_terms + term, d[c] * n_terms + items.terms[at]
    met = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
    hit = key[met] == want if len(key) else np.zeros(len(want), bool)
    np.add.at(score, c[hit], items.q[at[hit]] * impact[met[hit]])
    ok = score >= reach[i]
    return d[ok], i[ok], score[ok]


def search_block(index: DataFrame, corpus: Corpus, items: Seeded, k: int) -> DataFrame:
    """(item, score, id): the k best documents of each item and task."""
    sent, n_terms = index.sparkSession.sparkContext.broadcast(items), max(1, len(corpus.weights))
    kind = index.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, kept = sent.value, None
        least, shared = items.least.copy(), np.bincount(items.terms, minlength=n_terms)
        for batch in batches:
            doc, term, impact = corpus.postings(batch)
            cost = np.cumsum(shared[term])
            at = 0
            while at < len(doc):
                to = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + EXPANDED, "right"))
                to = int(np.searchsorted(doc, doc[min(max(to, at + 1), len(doc)) - 1], "right"))
                d, i, s = scored(doc[at:to], term[at:to], impact[at:to], items, least, n_terms)
                at = to
                if not len(d):
                    continue
                new = pa.table([pa.array(i), pa.array(s), batch.column(0).take(pa.array(d))], names=["item", "score", "id"])
                kept = best_of(new if kept is None else pa.concat_tables([kept, new]).combine_chunks(), k)
                item, score = kept.column("item").to_numpy(), kept.column("score").to_numpy()
                full = np.flatnonzero(np.bincount(item, minlength=len(least)) == k)
                low = np.full(len(least), np.iinfo(np.int64).max)
                np.minimum.at(low, item, score)
                least[full] = np.maximum(least[full], low[full])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return index.select("id", "n", "terms", "tfs").mapInArrow(search, f"item long, score long, id {kind}")


def blocks_of(rows: DataFrame, most: int = BLOCK) -> Iterator[DataFrame]:
    """Item terms, in blocks of whole items of at most so many rows, if a single item has not more."""
    n = max(1, -(-rows.count() // most))
    number = lambda n: F.pmod(F.xxhash64("item"), F.lit(n))
    while rows.groupBy(number(n).alias("b")).agg(F.count("*").alias("n"), F.countDistinct("item").alias("items")).where(f"n > {most} and items > 1").limit(1).count():
        n *= 2
    for b in range(n):
        yield rows.where(number(n) == b)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item, rank, id, score): the k best documents with a score above 0 of each item, ranks from 1, equal scores by ascending id.

    Null and empty texts have no terms. Documents with a null id count like others and come last among equal scores; each row is a
    document, repeated ids too. Items of one id are taken together, equal rows once; an item without a known term has no rows.
    Columns besides id and text are not looked at. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    wanted = written(item_terms(items, item_id, item_text), "item-terms")
    kind = docs.schema[id].dataType.simpleString()
    found = spark.createDataFrame([], f"item {wanted.schema['item'].dataType.simpleString()}, score long, id {kind}")
    for part in blocks_of(wanted, block):
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        terms = pc.unique(rows.column("term").combine_chunks().cast(pa.binary()))
        names = rows.column("item").combine_chunks().dictionary_encode("encode")
        index = written(forward_index(docs, id, text, terms), "index")
        total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        corpus = Corpus(total[0], total[1], weights)
        best, kth = np.zeros((2, len(terms)), np.int64)
        for r in term_seeds(index, corpus, k).toLocalIterator():
            best[r["term"]], kth[r["term"]] = r["best"], r["kth"]
        number = pc.index_in(rows.column("term").combine_chunks().cast(pa.binary()), value_set=terms).to_numpy().astype(np.int64)
        seeded = Seeded.of(names.indices.to_numpy().astype(np.int64), number, rows.column("q").to_numpy(), best, kth, len(names.dictionary))
        hits = written(search_block(index, corpus, seeded, k), "hits")
        ids = spark.createDataFrame(pa.table([pa.array(range(len(names.dictionary)), pa.int64()), names.dictionary], names=["_i", "_item"]))
        found = found.unionByName(hits.join(F.broadcast(ids), F.col("item") == F.col("_i")).select(F.col("_item").alias("item"), "score", "id"))
        discard(index)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id), "score")
