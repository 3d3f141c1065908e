"""A fixed public vocabulary of pieces in a double-array trie, and sums and maxima over all segmentations of words.

Everything here works on many words at once: one numpy step follows one more byte of every start position. A word never
contains a space other than leading whitespace markers, and no piece has a marker after another character, so texts can be
taken word by word without losing a segmentation.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """pieces: by id, as bytes; b"" for control pieces. byte_ids: the piece that stands for each single byte."""

    pieces: tuple[bytes, ...]
    byte_ids: tuple[int, ...]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read once on the driver. Pieces with a whitespace marker after another character are left out (there are none in the default file)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            pieces.append(b"")
        elif model.is_control(i) or model.is_unknown(i) or MARK in piece.lstrip(MARK) or "\n" in piece or (MARK in piece and " " in piece):
            pieces.append(b"")
        else:
            pieces.append(piece.encode())
    if min(byte_ids) < 0:
        raise ValueError(f"{path} has no piece for some byte; byte fallback needs all 256")
    return Vocabulary(tuple(pieces), tuple(byte_ids))


@dataclass(frozen=True)
class DoubleArray:
    """A trie over bytes: node n goes on byte b to base[n] + b + 1 if check there is n. value: the piece that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def of(pieces: tuple[bytes, ...]) -> DoubleArray:
        entries = sorted((p, i) for i, p in enumerate(pieces) if p)
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        first, todo = 1, [(0, 0, len(entries), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(entries[lo][0]) == depth:
                value[node] = entries[lo][1]
                lo += 1
            groups, at = [], lo
            while at < hi:
                byte, to = entries[at][0][depth], at
                while to < hi and entries[to][0][depth] == byte:
                    to += 1
                groups.append((byte, at, to))
                at = to
            if not groups:
                continue
            want = np.array([g[0] + 1 for g in groups])
            while True:
                if first + 4096 + 258 >= size:
                    grow = lambda a, fill: np.concatenate([a, np.full(size, fill, np.int32)])
                    base, check, value, size = grow(base, 0), grow(check, -1), grow(value, -1), 2 * size
                fits = np.flatnonzero((check[np.arange(first, first + 4096)[:, None] + want] < 0).all(1)) if len(want) > 1 else np.flatnonzero(check[first + want[0] : first + want[0] + 4096] < 0)
                if len(fits):
                    break
                first += 4096
            slot = first + int(fits[0])
            if len(fits) < 64:
                first += 64
            base[node] = slot
            check[slot + want] = node
            todo += [(slot + byte + 1, a, b, depth + 1) for byte, a, b in groups]
        check[0] = -1
        return DoubleArray(base, check, value, max((len(p) for p, _ in entries), default=0))


@functools.lru_cache(maxsize=4)
def trie(path: str = VOCABULARY) -> DoubleArray:
    return DoubleArray.of(vocabulary(path).pieces)


@dataclass
class Lattice:
    """All pieces that occur in a batch of words: by length, sorted by where they end in their word.

    by_length: (length, words, ends, ids). Words are in the order given; lengths: their bytes.
    """

    lengths: np.ndarray
    by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def most(self) -> int:
        return int(self.lengths.max(initial=0))


def lattice(tree: DoubleArray, byte_ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Lattice:
    """Match all pieces at all positions. Each single byte also has its fallback piece, given as length 0."""
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(data)) - offsets[:-1][word]
    left = lengths[word] - within
    where, state = np.arange(len(data)), np.zeros(len(data), np.int32)
    found = [(0, word, within + 1, byte_ids[data])]
    for step in range(tree.depth):
        alive = left[where] > step
        where, state = where[alive], state[alive]
        to = tree.base[state] + data[where + step] + 1
        ok = tree.check[to] == state
        where, state = where[ok], to[ok]
        if not len(where):
            break
        ids = tree.value[state]
        hit = ids >= 0
        if hit.any():
            at = where[hit]
            found.append((step + 1, word[at], within[at] + step + 1, ids[hit]))
    ordered = []
    for length, w, end, ids in found:
        by = np.argsort(end, kind="stable") if lengths.max(initial=0) > 65535 else np.argsort(end.astype(np.uint16), kind="stable")
        ordered.append((length, w[by], end[by], ids[by]))
    return Lattice(lengths, ordered)


def steps(found: Lattice):
    """(end, length, slice of that length's matches) in order of ends, then of falling length; the byte fallback comes last."""
    cuts = [(k, np.searchsorted(end, np.arange(1, found.most + 2))) for k, (_, _, end, _) in enumerate(found.by_length)][::-1]
    for j in range(1, found.most + 1):
        for k, cut in cuts:
            if cut[j - 1] < cut[j]:
                yield j, max(1, found.by_length[k][0]), k, slice(cut[j - 1], cut[j])


#: Each byte multiplies sums by this much, which keeps the sums of words of usual lengths near 1.
LIFT = np.exp(1.5)


def lifted(chance: np.ndarray, widths: np.ndarray) -> np.ndarray:
    return chance * LIFT ** widths[:, None]


def totals(found: Lattice, chance: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Natural logarithm (word, model) of the forward sum over all segmentations of each word.

    chance (piece, model): probabilities; widths: bytes of each piece. Words whose sums leave the range of doubles
    (hundreds of bytes without a space) are summed again as logarithms.
    """
    high = lifted(chance, widths)
    alpha = np.zeros((found.most + 1, len(found.lengths), chance.shape[1]))
    alpha[0] = 1
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for j, length, k, part in steps(found):
            w, ids = found.by_length[k][1][part], found.by_length[k][3][part]
            alpha[j, w] += alpha[j - length, w] * high[ids]
        end = alpha[found.lengths, np.arange(len(found.lengths))]
        out = np.log(end) - np.log(LIFT) * found.lengths[:, None]
    if len(odd := np.flatnonzero(~((end > 1e-250) & (end < 1e250)).all(1))):
        out[odd] = log_forward(picked(found, odd), np.log(np.maximum(chance, 1e-300)))[0]
    return out


def picked(found: Lattice, words: np.ndarray) -> Lattice:
    """The lattice of some of the words only."""
    to = np.full(len(found.lengths), -1)
    to[words] = np.arange(len(words))
    return Lattice(found.lengths[words], [(k, to[w[m]], end[m], ids[m]) for k, w, end, ids in found.by_length if (m := to[w] >= 0).any()])


def log_forward(found: Lattice, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole words' sums and the sums at each position, as logarithms."""
    ahead = np.full((found.most + 1, len(found.lengths), log.shape[1]), -np.inf)
    ahead[0] = 0
    for j, length, k, part in steps(found):
        w, ids = found.by_length[k][1][part], found.by_length[k][3][part]
        ahead[j, w] = np.logaddexp(ahead[j, w], ahead[j - length, w] + log[ids])
    return ahead[found.lengths, np.arange(len(found.lengths))], ahead


def expected(found: Lattice, chance: np.ndarray, widths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected counts (piece, model) of each piece in all segmentations, weighed by counts (word, model)."""
    out = np.zeros_like(chance)
    n, m = len(found.lengths), chance.shape[1]
    high = lifted(chance, widths)
    alpha, beta = np.zeros((2, found.most + 1, n, m))
    alpha[0] = 1
    beta[found.lengths, np.arange(n)] = 1
    todo = list(steps(found))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for j, length, k, part in todo:
            w, ids = found.by_length[k][1][part], found.by_length[k][3][part]
            alpha[j, w] += alpha[j - length, w] * high[ids]
        end = alpha[found.lengths, np.arange(n)]
        fine = ((end > 1e-250) & (end < 1e250)).all(1)
        share = np.where(fine[:, None], counts / end, 0)
        for j, length, k, part in reversed(todo):
            w, ids = found.by_length[k][1][part], found.by_length[k][3][part]
            tail = high[ids] * beta[j, w]
            beta[j - length, w] += tail
            weight = np.where(fine[w, None], alpha[j - length, w] * tail * share[w], 0)
            for x in range(m):
                out[:, x] += np.bincount(ids, weight[:, x], len(out))
    if len(odd := np.flatnonzero(~fine)):
        few, log = picked(found, odd), np.log(np.maximum(chance, 1e-300))
        whole, ahead = log_forward(few, log)
        behind = np.full(ahead.shape, -np.inf)
        behind[few.lengths, np.arange(len(odd))] = 0
        for j, length, k, part in reversed(list(steps(few))):
            w, ids = few.by_length[k][1][part], few.by_length[k][3][part]
            tail = log[ids] + behind[j, w]
            behind[j - length, w] = np.logaddexp(behind[j - length, w], tail)
            np.add.at(out, ids, np.exp(ahead[j - length, w] + tail - whole[w]) * counts[odd[w]])
    return out


def best(found: Lattice, score: np.ndarray, byte_score: float) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi: ids of the best segmentation of each word laid end to end, and offsets by word.

    Ties go to the longer last piece. Byte fallback costs byte_score a byte.
    """
    n, most = len(found.lengths), found.most
    top = np.full((n, most + 1), -np.inf)
    top[:, 0] = 0
    step, piece = np.zeros((n, most + 1), np.int32), np.full((n, most + 1), -1, np.int32)
    for j, length, k, part in steps(found):
        w, ids = found.by_length[k][1][part], found.by_length[k][3][part]
        value = top[w, j - length] + (score[ids] if found.by_length[k][0] else byte_score)
        better = value > top[w, j]
        w = w[better]
        top[w, j], step[w, j], piece[w, j] = value[better], length, ids[better]
    at, rows, back = found.lengths.copy(), np.arange(n), []
    while True:
        live = at[rows] > 0
        rows = rows[live]
        if not len(rows):
            break
        back.append((rows, piece[rows, at[rows]]))
        at[rows] -= step[rows, at[rows]]
    if not back:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    words, ids = np.concatenate([b[0] for b in back[::-1]]), np.concatenate([b[1] for b in back[::-1]])
    order = np.argsort(words, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(words, minlength=n))])


#: Longer words are walked alone, byte by byte, with what the walk has to remember bounded by a block.
LONG, BLOCK, RESCALE = 512, 1 << 15, 16


def matches(tree: DoubleArray, byte_ids: np.ndarray, data: np.ndarray, at: int, to: int) -> tuple[np.ndarray, list[int], list[int]]:
    """All pieces that start from at to to (exclusive) in data: how many before each start, their lengths and ids, by start, then
    falling length; the byte fallback comes last, with length 0.
    """
    part = data[at : min(len(data), to + tree.depth)]
    n = to - at
    where, state = np.arange(n), np.zeros(n, np.int32)
    starts, lengths, found = [where], [np.zeros(n, np.int64)], [byte_ids[part[:n]]]
    for step in range(tree.depth):
        alive = where + step < len(part)
        where, state = where[alive], state[alive]
        following = tree.base[state] + part[where + step] + 1
        ok = tree.check[following] == state
        where, state = where[ok], following[ok]
        if not len(where):
            break
        ids = tree.value[state]
        hit = ids >= 0
        starts.append(where[hit])
        lengths.append(np.full(int(hit.sum()), step + 1))
        found.append(ids[hit])
    start, length, ids = np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)
    order = np.lexsort((-length, start))
    return np.searchsorted(start[order], np.arange(n + 1)), length[order].tolist(), ids[order].tolist()


def best_long(tree: DoubleArray, byte_ids: np.ndarray, data: np.ndarray, score: np.ndarray, byte_score: float, block: int = BLOCK) -> np.ndarray:
    """The same ids as those of best for one word of any length. After each block, what all open paths have in common is handed
    out and forgotten.
    """
    value_of = score.tolist()
    top, step, piece = [0.0], [0], [-1]  # of the positions from origin on
    origin, out = 0, []
    worst = -np.inf

    def trace(end: int) -> list[int]:
        ids = []
        while end > origin:
            ids.append(piece[end - origin])
            end -= step[end - origin]
        return ids[::-1]

    for at in range(0, len(data), block):
        to = min(len(data), at + block)
        cuts, lengths, ids = matches(tree, byte_ids, data, at, to)
        more = min(len(data), to + tree.depth) - origin + 1 - len(top)
        top += [worst] * more
        step += [0] * more
        piece += [-1] * more
        cuts = cuts.tolist()
        for k in range(to - at):
            here = at - origin + k
            reached = top[here]
            for x in range(cuts[k], cuts[k + 1]):
                n, i = lengths[x], ids[x]
                v = reached + (value_of[i] if n else byte_score)
                end = here + (n or 1)
                if v > top[end]:
                    top[end], step[end], piece[end] = v, n or 1, i
        if to < len(data):
            open_ = {e for e in range(to - origin, len(top)) if top[e] > worst}
            while len(open_) > 1:
                last = max(open_)
                open_.remove(last)
                open_.add(last - step[last])
            common = open_.pop() + origin
            out += trace(common)
            del top[: common - origin], step[: common - origin], piece[: common - origin]
            origin = common
    return np.array(out + trace(len(data)), np.int32)


def total_long(tree: DoubleArray, byte_ids: np.ndarray, data: np.ndarray, chance: np.ndarray, widths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The same logarithms as those of totals for one word of any length. Sums are scaled anew every few bytes."""
    high = lifted(chance, widths)
    logs = np.zeros(chance.shape[1])
    for m in range(chance.shape[1]):
        value, ahead, log = high[:, m].tolist(), [1.0], 0.0
        for at in range(0, len(data), block):
            to = min(len(data), at + block)
            cuts, lengths, ids = matches(tree, byte_ids, data, at, to)
            ahead += [0.0] * (min(len(data), to + tree.depth) - at + 1 - len(ahead))
            cuts = cuts.tolist()
            for k in range(to - at):
                reached = ahead[k]
                for x in range(cuts[k], cuts[k + 1]):
                    ahead[k + (lengths[x] or 1)] += reached * value[ids[x]]
                if k % RESCALE == RESCALE - 1 and (most := max(ahead[k + 1 : k + 1 + tree.depth], default=0.0)) > 0:
                    ahead[k + 1 : k + 1 + tree.depth] = [a / most for a in ahead[k + 1 : k + 1 + tree.depth]]
                    log += np.log(most)
            ahead = ahead[to - at :]
        logs[m] = np.log(ahead[-1]) + log - np.log(LIFT) * len(data)
    return logs


def in_buckets(data: np.ndarray, offsets: np.ndarray, most_cells: int = 1 << 18, longest_word: int = LONG):
    """(numbers of words, their bytes, their offsets) in groups of like length, so that padding stays small. Empty words and those
    over longest_word are left out.
    """
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], 1) : np.searchsorted(lengths[order], longest_word, "right")]
    at = 0
    while at < len(order):
        longest = max(8, int(lengths[order[at]] * 3 // 2))
        to = min(int(np.searchsorted(lengths[order], longest, "right")), at + max(1, most_cells // (longest + 1)))
        part = order[at:to]
        own = lengths[part]
        ends = np.concatenate([[0], np.cumsum(own)])
        take = np.repeat(offsets[part] - ends[:-1], own) + np.arange(ends[-1])
        yield part, data[take], ends
        at = to
