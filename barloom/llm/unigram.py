"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, whitespace markers."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as P
from .words import plain, raw, slices

#: Bytes of text, and ids, that are worked on at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class Codec:
    """A vocabulary with log scores. In the trie a marker is the space that it stands for, so a marker character that a text
    itself holds is spelled in bytes and comes back as it was.
    """

    tree: P.DoubleArray
    pieces: tuple[bytes, ...]
    byte_ids: np.ndarray
    score: np.ndarray
    byte_score: float

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def load(path: str = P.VOCABULARY) -> Codec:
        """Log scores are those of Zipf's law over the vocabulary's ranks. A fallback byte scores 10 below the rarest piece."""
        v = P.vocabulary(path)
        pieces = tuple(p.replace(P.MARK.encode(), b" ") for p in v.pieces)
        rank = np.cumsum([bool(p) for p in pieces])
        score = -np.log(rank + 1.0) - np.log(np.log(len(pieces)))
        decoded = list(pieces)
        for b, i in enumerate(v.byte_ids):
            decoded[i] = bytes([b])
        return Codec(P.DoubleArray.of(pieces), tuple(decoded), np.array(v.byte_ids), score, float(score.min() - 10))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Lists of piece ids; null for null, empty for empty texts."""
        out = [self._encode(part) for part in slices(plain(texts), SLICE)]
        lists = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        if texts.null_count:
            lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=texts.is_null())
        return lists

    def _encode(self, texts: pa.Array) -> pa.Array:
        data, offsets = raw(texts)
        if len(texts) == 1 and len(data) > 2 * SLICE:
            ids = np.concatenate([self._coded(part, np.array([0, len(part)]))[0] for part in blocks(data)])
            ends = np.array([0, len(ids)])
        else:
            ids, ends = self._coded(data, offsets)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def _coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and where each text's end."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = boundaries(data)
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        segments = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        coded = segments.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        own, ends = raw(coded.dictionary)
        counts, found = np.zeros(len(ends) - 1, np.int64), []
        for numbers, part, part_ends in P.in_buckets(own, ends):
            ids, id_ends = P.best(P.lattice(self.tree, self.byte_ids, part, part_ends), self.score, self.byte_score)
            counts[numbers] = np.diff(id_ends)
            found.append((numbers, ids))
        for k in np.flatnonzero(np.diff(ends) > P.LONG):
            ids = P.best_long(self.tree, self.byte_ids, own[ends[k] : ends[k + 1]], self.score, self.byte_score)
            counts[k] = len(ids)
            found.append((np.array([k]), ids))
        starts = np.zeros(len(counts), np.int64)
        at = 0
        for numbers, ids in found:
            starts[numbers] = at + np.concatenate([[0], np.cumsum(counts[numbers])[:-1]])
            at += len(ids)
        ids, ends = ragged(np.concatenate([x for _, x in found]), starts[which], counts[which])
        return ids, ends[np.searchsorted(cuts, offsets)]

    def decode(self, lists: pa.Array) -> pa.Array:
        """Texts of lists of ids. Control pieces and numbers that are no ids give nothing; bytes that are no UTF-8 give U+FFFD."""
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in self.spelled(lists)], pa.string())

    def spelled(self, lists: pa.Array) -> Iterator[bytes | None]:
        """The bytes of each list of ids, at most about SLICE ids at a time."""
        sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            some = lists.slice(at, to - at)
            ids = some.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            if len(ids) > SLICE:  # one list, longer than that
                yield b"".join(self._spelled(ids[x : x + SLICE])[0] for x in range(0, len(ids), SLICE))
            else:
                blob, widths = self._spelled(ids)
                own = np.concatenate([[0], np.cumsum(widths)])[ends[at : to + 1] - ends[at]].tolist()
                for k, ok in enumerate(some.is_valid().to_pylist()):
                    yield blob[own[k] : own[k + 1]] if ok else None
            at = to

    def _spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        lengths = np.array([len(p) for p in self.pieces] + [0], np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.pieces)), ids, len(self.pieces))
        data, _ = ragged(np.frombuffer(b"".join(self.pieces), np.uint8), (np.cumsum(lengths) - lengths)[ids], lengths[ids])
        return data.tobytes(), lengths[ids]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places that no piece goes over: before a space that follows another character, and around line feeds. One more than bytes."""
    cut = np.zeros(len(data) + 1, bool)
    space, line = data == 0x20, data == 0x0A
    cut[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return cut


def blocks(data: np.ndarray, size: int = SLICE) -> Iterator[np.ndarray]:
    """A long text in parts of about size bytes that end at boundaries; one without a boundary for long is a longer part."""
    at, look = 0, size
    while at < len(data):
        if at + look >= len(data):
            yield data[at:]
            return
        cuts = np.flatnonzero(boundaries(data[at : at + look]))
        if len(cuts):
            yield data[at : at + cuts[-1]]
            at, look = at + int(cuts[-1]), size
        else:
            look *= 2


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values laid end to end, and the offsets of the runs."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    take = np.repeat(starts - ends[:-1], counts)
    take += np.arange(ends[-1])
    return values[take], ends


def encode(text: str | Column, path: str = P.VOCABULARY) -> Column:
    """Ids of the best segmentation of a whole text into pieces; null for a null text."""
    codec = Codec.load(path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return codec.encode(texts)

    return ids.asNondeterministic()(text)


def decode(ids: str | Column, path: str = P.VOCABULARY) -> Column:
    """The text that ids spell; null for null."""
    codec = Codec.load(path)

    @F.arrow_udf(T.StringType())
    def texts(lists: pa.Array) -> pa.Array:
        return codec.decode(lists)

    return texts.asNondeterministic()(ids)


CODED = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def round_trip(text: str | Column, path: str = P.VOCABULARY) -> Column:
    """(piece_ids, round_trip) of a whole text in one pass: its ids, and whether decoding them gives its bytes back. A null text has
    null ids, which decode to null: true.
    """
    codec = Codec.load(path)

    @F.arrow_udf(CODED)
    def both(texts: pa.Array) -> pa.Array:
        ids, same = [pa.array([], pa.list_(pa.int32()))], []
        for part in slices_of(texts):
            ids.append(codec.encode(part))
            same += [b == t.as_py() for b, t in zip(codec.spelled(ids[-1]), part.cast(pa.binary()), strict=True)]
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(same, pa.bool_())], ["piece_ids", "round_trip"])

    return both.asNondeterministic()(text)


def slices_of(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of texts with their nulls."""
    at = 0
    for part in slices(plain(texts), SLICE):
        yield texts.slice(at, len(part))
        at += len(part)


def tokenized(docs: DataFrame, text: str = "text", into: str = "piece_ids", path: str = P.VOCABULARY) -> DataFrame:
    """docs with each text's ids in the column named by into; a column of that name is replaced."""
    return docs.withColumn(into, encode(F.col(text), path))
