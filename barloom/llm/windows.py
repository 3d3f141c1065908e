"""Runs of byte windows that share their smallest hash, so that equal windows of different texts meet."""

from __future__ import annotations

import numpy as np
import xxhash

GRAM, LONGEST_RUN = 64, 256
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes from each position on; gram is a power of two. Doubling: two halves make a whole."""
    h, width, factor = _TABLE[data], 1, _BASE
    while width < gram:
        nxt = h[:-width] * np.uint64(factor)
        nxt += h[width:]
        h, width, factor = nxt, 2 * width, factor * factor % 2**64
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    done, least = 1, h
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def met_again(h: np.ndarray, least: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each hash in of, whether it is the smallest of some window at two positions or more: only then can a window occur
    twice within one run.
    """
    pad = np.zeros(len(h) - len(least), np.uint64)
    reached = sliding_least(~np.concatenate([pad, least, pad]), len(pad) + 1)
    values, counts = np.unique(h[h == ~reached], return_counts=True)
    values = values[counts > 1]
    if not len(values):
        return np.zeros(len(of), bool)
    return values[np.minimum(np.searchsorted(values, of), len(values) - 1)] == of


def runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int = GRAM, longest: int = LONGEST_RUN, again: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, first, last) of each run: windows that start from first to last, both in one text, and share their smallest hash;
    with again, also what met_again says of the hash.
    """
    if len(data) < window:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))[: 3 + again]
    h = gram_hashes(data, gram)
    least = sliding_least(h, window - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[: len(least)] == text[window - 1 :]
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(starts)
    if (lengths > longest).any():
        pieces = -(-lengths // longest)
        cut = np.repeat(starts[:-1], pieces) + longest * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        starts = np.append(cut, starts[-1])
    first, last = starts[:-1], starts[1:] - 1
    ok = inside[first]
    found = least[first[ok]], first[ok], last[ok]
    return (*found, met_again(h, least, found[0])) if again else found


def region_digests(data: bytes, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """64-bit digests of all bytes that a run's windows cover. Beside the hash that the run shares, they tell regions apart."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a : b + window]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64).view(np.int64)
