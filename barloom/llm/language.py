"""Language identification by unigram pieces summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as P
from .shared import written
from .words import coded, plain, raw, slices, split, sums

UNKNOWN = "und"
PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
#: Bytes of text that are worked on at once.
SLICE = 2 << 20
#: Texts of one language differ by this much per byte at least, however alike the learning texts are.
LEAST_DEVIATION = 0.05


def word_lattices(tree: P.DoubleArray, byte_ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """(numbers of words, their lattice) over all words but those over P.LONG bytes."""
    for part, own, ends in P.in_buckets(data, offsets):
        yield part, P.lattice(tree, byte_ids, own, ends)


def marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, each with the whitespace marker in front, and their offsets."""
    return raw(pc.binary_join_element_wise(pa.scalar(P.MARK), words, ""))


def cut_up(data: np.ndarray, offsets: np.ndarray, longest: int = P.LONG) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of words of at most longest bytes, cut before a character; and of each, which word it is part of. For learning only."""
    pieces = np.maximum(1, -(-np.diff(offsets) // (longest - 3)))
    which = np.repeat(np.arange(len(pieces)), pieces)
    within = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = offsets[which] + within * (longest - 3)
    for _ in range(3):
        inner = np.flatnonzero(within)
        cut[inner] += (data[cut[inner]] & 0xC0) == 0x80
    return np.append(cut, offsets[-1]), which


@dataclass(frozen=True)
class LanguageModel:
    """chance (piece, language): each language's probabilities over the vocabulary's pieces. typical: by language, mean and
    deviation over its learning texts of the logarithm of a text's probability per byte.
    """

    langs: tuple[str, ...]
    chance: np.ndarray
    path: str = P.VOCABULARY
    typical: tuple[tuple[float, float], ...] = ()

    def predict(self, text: str | Column) -> Column:
        """(lang_pred, score, fit) of a whole text: the language of the highest probability summed over all segmentations, and its
        posterior under equal priors. fit: by how many deviations its probability per byte, over words with a letter and no digit,
        is above what is typical of the language; null where there is no such word. Null texts, texts without a letter and
        models of no language give und and 0.
        """
        model, tools, langs = self, self.tools(), self.langs
        typical = np.array(self.typical or [(0.0, 1.0)] * len(langs)).reshape(-1, 2)

        @F.arrow_udf(PREDICTED)
        def score(texts: pa.Array) -> pa.Array:
            names, values, fits = [], [], []
            for part in slices(plain(texts), SLICE):
                letters = pc.match_substring_regex(part, r"\pL").to_numpy(zero_copy_only=False)
                if langs:
                    total, of_plain, n_bytes = model.logarithms(part, *tools)
                    top = total.argmax(1)
                    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    per_byte = of_plain[np.arange(len(top)), top] / np.maximum(1, n_bytes)
                    names += [langs[k] if ok else UNKNOWN for k, ok in zip(top, letters, strict=True)]
                    values.append(np.where(letters, posterior, 0))
                    fits.append(np.where(n_bytes > 0, (per_byte - typical[top, 0]) / typical[top, 1], np.nan))
                else:
                    names += [UNKNOWN] * len(part)
                    values.append(np.zeros(len(part)))
                    fits.append(np.full(len(part), np.nan))
            whole = lambda x: np.concatenate(x or [np.zeros(0)])
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(whole(values)), pa.array(whole(fits), from_pandas=True)], ["lang_pred", "score", "fit"])

        return score.asNondeterministic()(text)

    def tools(self) -> tuple[P.DoubleArray, np.ndarray, np.ndarray]:
        """Trie, byte pieces and widths of pieces, made on the driver: executors need not have the vocabulary's file."""
        vocabulary = P.vocabulary(self.path)
        return P.trie(self.path), np.array(vocabulary.byte_ids), np.array([len(p) or 1 for p in vocabulary.pieces])

    def logarithms(self, texts: pa.Array, tree: P.DoubleArray, byte_ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logarithms (text, language) of the sums over all segmentations; the same over words with a letter and no digit, and
        the bytes of these, as numbers and keys tell little of how well a language fits.
        """
        words, offsets = split(texts)
        distinct, which = coded(words)
        table = np.zeros((len(distinct), len(self.langs)))
        data, ends = marked(distinct)
        for numbers, found in word_lattices(tree, byte_ids, data, ends):
            table[numbers] = P.totals(found, self.chance, widths)
        for k in np.flatnonzero(np.diff(ends) > P.LONG):
            table[k] = P.total_long(tree, byte_ids, data[ends[k] : ends[k + 1]], self.chance, widths)
        plain_words = pc.and_(pc.match_substring_regex(distinct, r"\pL"), pc.invert(pc.match_substring_regex(distinct, r"\p{Nd}"))).to_numpy(zero_copy_only=False)
        return sums(table[which], offsets), sums((table * plain_words[:, None])[which], offsets), sums((np.diff(ends) * plain_words)[which], offsets)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 2000, rounds: int = 2, path: str = P.VOCABULARY) -> LanguageModel:
    """Piece probabilities by expectation-maximisation over all segmentations.

    The classifier is fitted on a sample of about rows_per_language distinct labelled texts of each language, drawn by a hash of
    the text and written down; a language with fewer uses them all. A text teaches a language once, however often it is repeated, so
    copies neither fill the sample nor leave it empty; how many distinct texts there are is told by a sketch, within some 5 %.
    Rows with a null language or text teach nothing; words over P.LONG bytes teach in parts. What reaches the driver is one count per language and, each round, one expected count per
    language and piece.
    """
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    langs = tuple(sorted(counts))
    vocabulary, tree = P.vocabulary(path), P.trie(path)
    byte_ids, widths = np.array(vocabulary.byte_ids), np.array([len(p) or 1 for p in vocabulary.pieces])
    size = len(vocabulary.pieces)
    usable = np.array([bool(p) for p in vocabulary.pieces])
    usable[byte_ids] = True
    chance = np.repeat((usable / usable.sum())[:, None], len(langs), 1)
    if not langs:
        return LanguageModel((), chance, path)
    parts = 1_000_000
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(-(-parts * rows_per_language // max(1, counts[k]))))])
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(parts)) < share[F.col("lang")])
    sample = written(drawn.distinct(), "language-sample")

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, len(langs)))
        for batch in batches:
            own = batch.column("lang").to_pylist()
            at = 0
            for part in slices(plain(batch.column("text")), SLICE):
                words, offsets = split(part)
                distinct, which = coded(words)
                lang_of = np.repeat([langs.index(x) for x in own[at : at + len(part)]], np.diff(offsets))
                n = np.bincount(which * len(langs) + lang_of, minlength=len(distinct) * len(langs)).reshape(-1, len(langs)).astype(float) if len(which) else np.zeros((0, len(langs)))
                data, ends = marked(distinct)
                ends, word = cut_up(data, ends)
                for numbers, found in word_lattices(tree, byte_ids, data, ends):
                    out += P.expected(found, chance, widths, n[word[numbers]])
                at += len(part)
        piece, model = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(model.astype(np.int32)), pa.array(out[piece, model])], ["piece", "model", "n"])

    for _ in range(rounds):
        got = sample.mapInArrow(expect, "piece int, model int, n double").groupBy("piece", "model").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros((size, len(langs)))
        n[got["piece"], got["model"]] = got["n"]
        n += 0.01 * usable[:, None]
        chance = n / n.sum(0)
    model = LanguageModel(langs, chance, path)
    tools = model.tools()

    def per_byte(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64), 0
            for part in slices(plain(batch.column("text")), SLICE):
                _, total, n_bytes = model.logarithms(part, *tools)
                lang = own[at : at + len(part)]
                some = n_bytes > 0
                x = total[np.arange(len(part)), lang][some] / n_bytes[some]
                lang = lang[some]
                sums_of = [np.bincount(lang, w, len(langs)).astype(float) for w in (np.ones(len(x)), x, x * x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs), dtype=np.int32)), *map(pa.array, sums_of)], ["model", "n", "x", "xx"])
                at += len(part)

    got = {r["model"]: r for r in sample.mapInArrow(per_byte, "model int, n double, x double, xx double").groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx")]).collect()}
    typical = []
    for k in range(len(langs)):
        n, x, xx = (got[k][c] for c in ("n", "x", "xx")) if k in got else (0, 0, 0)
        mean = x / max(1, n)
        typical.append((mean, max(LEAST_DEVIATION, (max(0.0, xx / max(1, n) - mean * mean)) ** 0.5)))
    return LanguageModel(langs, chance, path, tuple(typical))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """docs with (lang_pred, score, fit) in the struct column named by into; a column of that name is replaced."""
    return docs.withColumn(into, model.predict(F.col(text)))
