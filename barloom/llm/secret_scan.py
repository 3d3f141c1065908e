"""Secret scans: fixed patterns, and windows of high Shannon entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import plain, slices

#: The base patterns, in the order in which kinds are listed, with the group and least length that count.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
ASSIGN_HINT = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass(frozen=True)
class CharClass:
    """Characters that one kind of secret is made of, and what a window of them must reach.

    needs: sets of characters of which the window must hold so many, which keeps plain words out. turns: how often in a window a
    letter or digit must be followed by one of another set (digits, small, capital letters), a capital before a small letter
    not counted: names such as HelloWorld2024 turn seldom.
    """

    name: str
    letters: str
    window: int
    bits: float
    needs: tuple[tuple[str, int], ...]
    turns: int = 0


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", DIGITS + "abcdefABCDEF", 24, 3.0, ((DIGITS, 2), ("abcdefABCDEF", 2))),
    CharClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_=-", 16, 3.3, ((DIGITS, 1), (LOWER, 1), (UPPER, 1)), 4),
    CharClass("entropy_lower", DIGITS + LOWER, 20, 3.2, ((DIGITS, 3), (LOWER, 3)), 4),
    CharClass("entropy_upper", DIGITS + UPPER, 20, 3.2, ((DIGITS, 3), (UPPER, 3)), 4),
)
_SET = {c: k for k, of in enumerate((DIGITS, LOWER, UPPER)) for c in of}
#: Bytes of text that are worked on at once.
SLICE = 2 << 20
#: Windows that touch one of these are not reported.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh",
    r"(.)\1{7}",
)
#: A word of at most so many letters and digits counts as a placeholder whole if a part of it is allowed.
PLACEHOLDER = 40
WORD = re.compile("[A-Za-z0-9]+")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def free(runs: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of runs that no taken span covers. Both are in order and apart, so each is passed once."""
    k = 0
    for start, end in runs:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < end:
            if taken[j][0] > start:
                yield start, taken[j][0]
            start = max(start, taken[j][1])
            j += 1
        k = max(k, j - 1)
        if start < end:
            yield start, end


def turns(a: str, b: str) -> bool:
    """Whether b, after a, is of another set; a small letter after a capital is not."""
    x, y = _SET.get(a, 3), _SET.get(b, 3)
    return x != y and x < 3 and y < 3 and (x, y) != (2, 1)


def windows_over(text: str, kind: CharClass, log: list[float]) -> list[tuple[int, int]]:
    """Where windows of kind.window characters reach kind.bits, merged. Counts are updated for one character in and out.

    log holds c * log2(c) by count: the entropy of a window of w characters is log2(w) - sum(c * log2 c) / w.
    """
    w, found = kind.window, []
    most = w * (math.log2(w) - kind.bits) + 1e-9
    need = [(frozenset(s), n) for s, n in kind.needs]
    counts: dict[str, int] = {}
    has = [0] * len(need)
    total, turned = 0.0, 0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        turned += i > 0 and turns(text[i - 1], c)
        for k, (s, _) in enumerate(need):
            has[k] += c in s
        if i >= w:
            old = text[i - w]
            n = counts[old]
            counts[old] = n - 1
            total += log[n - 1] - log[n]
            turned -= turns(old, text[i - w + 1])
            for k, (s, _) in enumerate(need):
                has[k] -= old in s
        if i >= w - 1 and total <= most and turned >= kind.turns and all(h >= n for h, (_, n) in zip(has, need, strict=True)):
            if found and found[-1][1] >= i - w + 1:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i - w + 1, i + 1))
    return found


def whole(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with the rest of the letters and digits that they begin or end in, so that no part of a key is left."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        while a > 0 and text[a] in _SET and text[a - 1] in _SET:
            a -= 1
        while b < len(text) and text[b - 1] in _SET and text[b] in _SET:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    """Finds the spans of a text; built once per task."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> None:
        self.classes = classes
        self.allowed = [re.compile(a) for a in allowed]
        self.candidate = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % min(c.window for c in classes))
        self.runs = {c.name: re.compile("[%s]{%d,}" % (re.escape(c.letters), c.window)) for c in classes}
        self.log = [0.0] + [n * math.log2(n) for n in range(1, 2 + max(c.window for c in classes))]
        self.rank = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(c.name for c in classes)])}
        self.hint = ASSIGN_HINT + "|[A-Za-z0-9+/_=-]{%d}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}" % min(c.window for c in classes)

    def excused(self, run: str) -> list[tuple[int, int]]:
        """Where a candidate string is on the allow-list, with the short words there."""
        hits = sorted(m.span() for a in self.allowed for m in a.finditer(run))
        if not hits:
            return []
        out, k, reach = list(hits), 0, 0
        for word in WORD.finditer(run):
            while k < len(hits) and hits[k][0] < word.end():
                reach = max(reach, hits[k][1])
                k += 1
            if reach > word.start() and word.end() - word.start() <= PLACEHOLDER:
                out.append(word.span())
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        base, at = merged([(s, e) for _, s, e in found]), 0
        for m in self.candidate.finditer(text):
            while at < len(base) and base[at][1] <= m.start():
                at += 1
            to = at
            while to < len(base) and base[to][0] < m.end():
                to += 1
            taken = merged(base[at:to] + [(s + m.start(), e + m.start()) for s, e in self.excused(m[0])])
            for kind in self.classes:
                own: list[tuple[int, int]] = []
                runs = ((m.start() + run.start(), m.start() + run.end()) for run in self.runs[kind.name].finditer(m[0]))
                for start, end in free(runs, taken):
                    if end - start >= kind.window:
                        part = text[start:end]
                        own += [(s + start, e + start) for s, e in whole(part, windows_over(part, kind, self.log))]
                found += [(kind.name, s, e) for s, e in own]
                taken = merged(taken + own) if own else taken
        return sorted(found, key=lambda x: (x[1], self.rank[x[0]], x[2]))


def secret_spans(text: str | Column, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of secrets in a text, as an array of (kind, start, end) by start, then kind; code points, end exclusive.

    Base patterns come first and stay; a window that meets the entropy of its character class is added where it overlaps
    no span yet and nothing on the allow-list, whatever else its candidate string holds. A null text counts as empty and has no spans.
    """

    @F.arrow_udf(SPAN)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = Scanner(classes, allowed)
        out: list[list[dict]] = []
        for part in slices(plain(texts), SLICE):
            maybe = pc.match_substring_regex(part, scanner.hint).to_pylist()
            rows = iter(part.filter(pa.array(maybe)).to_pylist())
            out += [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(next(rows))] if hit else [] for hit in maybe]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return scan.asNondeterministic()(text)


def redacted(text: str | Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping secret spans replaced by the mask. A null text stays null."""

    @F.arrow_udf(T.StringType())
    def redact(texts: pa.Array) -> pa.Array:
        scanner = Scanner()
        out: list[str | None] = []
        for part in slices(plain(texts), SLICE):
            for s, hit in zip(part.to_pylist(), pc.match_substring_regex(part, scanner.hint).to_pylist(), strict=True):
                if hit and (spans := scanner.spans(s)):
                    kept, until = [], 0
                    for _, a, b in spans:
                        if a >= until:
                            kept += [s[until:a], mask]
                        until = max(until, b)
                    s = "".join([*kept, s[until:]])
                out.append(s)
        valid = texts.is_valid().to_pylist()
        return pa.array([s if v else None for s, v in zip(out, valid, strict=True)], pa.string())

    return redact.asNondeterministic()(text)


def scan_secrets(df: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """df with the spans of each row's secrets in the column named by into; a column of that name is replaced, all others stay."""
    return df.withColumn(into, secret_spans(F.col(text)))
