"""Words of texts, an Arrow batch at a time. A word is a run of bytes other than 0x20 and 0x09 to 0x0D.

The functions that scan texts are declared as not deterministic, though they are: else Spark would copy them into each filter
and column that uses their result, and scan the texts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def plain(texts: pa.Array) -> pa.Array:
    """Texts as a plain string array with empty texts for nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def slices(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[pa.Array]:
    """Consecutive slices of at most about most_bytes; a longer text has a slice of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, int)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield texts.slice(at, to - at)
        at = to


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the offsets at which each text's words begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        words = words.filter(pa.array(full))
    return words, offsets.astype(np.int64)


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the number of its word for each one."""
    d = words.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array laid end to end, and its offsets."""
    binary = strings.cast(pa.binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64) if len(binary) else np.zeros(1, np.int64)
    data = binary.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def runs_of(texts: pa.Array, inside: np.ndarray, lead: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, text) of the maximal runs of bytes for which inside is true, none across texts: the runs' bytes end to end,
    with A-Z lowered, their offsets, and the number of each one's text. Bytes that continue a character that begins with lead
    belong to runs too.
    """
    data, ends = raw(texts)
    mask = inside[data]
    if lead is not None and len(data):
        mask[1:] |= (data[:-1] == lead) & (data[1:] >> 6 == 2)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    begins[first] = mask[first]
    starts = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(mask)[starts] - 1, mask.sum())
    return LOWER[data[mask]], offsets, np.searchsorted(ends, starts, "right") - 1


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow array of the byte strings between consecutive offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row, all places from its start on, as many as its size."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows of values between consecutive offsets; 0 where there is none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]
