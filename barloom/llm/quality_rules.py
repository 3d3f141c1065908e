"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .words import coded, plain, slices, split

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Lines with a word, letters, capital letters, digits, and characters of scripts that put no spaces between words.
MORE = ("n_lines", "n_letters", "n_capitals", "n_digits", "n_unspaced")
COUNTED = T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)])
#: The characters that count as symbols, and the bytes that part words.
SYMBOLS, SPACES = "#*$%&|<>", (" ", "\t", "\n", "\v", "\f", "\r")
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


def repeats(word: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """By text, the words in windows of three words that occur twice or more in it, the first time included. Words are numbers."""
    if len(word) < 3:
        return np.zeros(n, np.int64)
    most = np.int64(word.max() + 1)
    _, pair = np.unique(word[:-1] * most + word[1:], return_inverse=True)
    _, window = np.unique(pair[:-1] * most + word[2:], return_inverse=True)
    inside = np.flatnonzero(text[:-2] == text[2:])
    _, which, often = np.unique(window[inside] * np.int64(n) + text[inside], return_inverse=True, return_counts=True)
    hit = inside[often[which] > 1]
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(text[covered], minlength=n)


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """By text, its lines that hold a word, and those of them that are equal to an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    lines, text = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    text = text[full.to_numpy(zero_copy_only=False)]
    _, which = coded(lines.filter(full))
    n_lines = np.bincount(text, minlength=len(texts))
    kinds = np.unique(which.astype(np.int64) * len(texts) + text)
    return n_lines, n_lines - np.bincount(kinds % max(1, len(texts)), minlength=len(texts))


def counted(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS and MORE of a slice of texts."""
    words, offsets = split(texts)
    _, which = coded(words)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    of = lambda c: pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(np.int64)
    like = lambda c: pc.count_substring_regex(texts, c).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) - sum(of(c) for c in SPACES)
    n_lines, n_dup = repeated_lines(texts)
    return [np.diff(offsets), chars, sum(of(c) for c in SYMBOLS), n_dup, repeats(which.astype(np.int64), text, len(texts)), n_lines, like(r"\pL"), like(r"\p{Lu}"), like(r"\p{Nd}"), like(UNSPACED)]


def text_counts(text: str | Column) -> Column:
    """The counts that rules look at, over the whole text. A null text counts as empty."""

    @F.arrow_udf(COUNTED)
    def count(texts: pa.Array) -> pa.Array:
        parts = [counted(part) for part in slices(plain(texts), SLICE)]
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(COUNTED)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in whole], COUNTED.names)

    return count.asNondeterministic()(text)


@dataclass(frozen=True)
class Rule:
    """good and bad are SQL conditions over the counts; a rule for which neither holds abstains. A rule may have one of them only."""

    name: str
    good: str
    bad: str


#: Bad is what breaks a limit such as the published heuristics for web text have (words of a document, characters of a word, symbols
#: to words, digits and capitals to letters, repeated words and lines), good what keeps well within it; in between, a rule abstains.
RULES = (
    Rule("length", "n_words between 100 and 50000", "n_words < 20 or n_words > 100000"),
    Rule("word_length", "2 * n_unspaced <= word_chars and word_chars - n_unspaced between 4 * n_words and 8 * n_words", "2 * n_unspaced <= word_chars and (word_chars - n_unspaced < 3 * n_words or word_chars - n_unspaced > 10 * n_words)"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("digits", "20 * n_digits <= n_letters + n_digits", "10 * n_digits > 3 * (n_letters + n_digits)"),
    Rule("capitals", "10 * n_capitals <= n_letters", "10 * n_capitals > 3 * n_letters"),
    Rule("letters", "10 * n_letters >= 9 * word_chars", "10 * n_letters < 7 * word_chars"),
    Rule("repetition", "10 * n_repeat_words <= n_words and 10 * n_dup_lines <= n_lines", "10 * n_repeat_words > 3 * n_words or 10 * n_dup_lines > 3 * n_lines"),
)
#: Texts for which the verdict is settled beforehand; the rules learn nothing from them.
FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def votes(rules: tuple[Rule, ...]) -> Column:
    """One letter per rule: g, b or - (abstains)."""
    return F.concat(*[F.when(F.expr(r.bad), "b").when(F.expr(r.good), "g").otherwise("-") for r in rules])


#: Beliefs about a rule's answers (good, bad, abstains) in rows of each class: in good texts, in texts with its own fault, and in texts
#: with another one.
OF_GOOD, OF_FAULT, OF_OTHERS = np.array([27.0, 1.0, 2.0]), np.array([0.5, 29.0, 0.5]), np.array([1.0, 0.1, 0.5])


def estimated(n: np.ndarray, one: np.ndarray, faults: list[int], rounds: int) -> tuple[np.ndarray, float]:
    """Posterior of each class (good, then each of the faults) by pattern, and the log-likelihood of all rows.

    Expectation-maximisation. A pattern without a bad vote is good, whatever the rules' rates; the others start half good, half
    of the faults whose rules say bad.
    """
    fired = one[:, faults, 1]
    clean = ~one[:, :, 1].any(1)
    some = fired.sum(1, keepdims=True)
    share = np.column_stack([np.where(some[:, 0] > 0, 0.5, 1.0), 0.5 * fired / np.maximum(1, some)])
    prior = np.tile(OF_OTHERS, (1 + len(faults), one.shape[1], 1))
    prior[0] = OF_GOOD
    prior[1 + np.arange(len(faults)), faults] = OF_FAULT
    for _ in range(rounds):
        answers = np.einsum("p,pc,pra->cra", n, share, one) + prior
        size = np.einsum("p,pc->c", n, share) + 1
        log = np.log(size / size.sum()) + np.einsum("pra,cra->pc", one, np.log(answers / answers.sum(2, keepdims=True)))
        log[clean, 1:] = -np.inf
        most = log.max(1, keepdims=True)
        share = np.exp(log - most)
        total = share.sum(1, keepdims=True)
        share /= total
    return share, float(n @ (most + np.log(total))[:, 0])


def fit(patterns: dict[str, int], n_rules: int, rounds: int = 100) -> dict[str, float]:
    """Posterior probability of good by pattern of votes.

    A hidden class is good or one rule's fault: faulty texts mostly have one fault and look fine to many rules, so with a single
    class of bad texts those rules' good votes, which are not independent evidence then, would outvote the ones that saw it. In
    each class each rule has probabilities of its three answers; expectation-maximisation estimates them and the classes' shares.

    A rule is trusted as far as others bear it out. Faults become classes one after the other, each time the one that explains the
    rows best, as long as it adds more log-likelihood than the class has free parameters (Akaike's criterion). It does if texts
    that the rule calls bad are answered otherwise by the other rules too. Bad votes that go with nothing else are taken for false alarms
    among good texts. So a noisy rule is outvoted, whether it speaks up often or rarely, and a fault that one rule
    alone can see needs a second rule. A pattern without a bad vote is good. In a table of few rows nothing is borne out, and all
    are kept. Ties go to the earlier rule.
    """
    names = sorted(patterns)
    if not names:
        return {}
    n = np.array([patterns[p] for p in names], float)
    one = np.eye(3)[np.array([["gb-".index(c) for c in p] for p in names]).reshape(len(names), n_rules)]
    faults: list[int] = []
    share, known = estimated(n, one, faults, rounds)
    while left := [r for r in range(n_rules) if r not in faults and one[:, r, 1].any()]:
        tried = {r: estimated(n, one, [*faults, r], rounds) for r in left}
        best = max(left, key=lambda r: tried[r][1])
        if tried[best][1] - known <= 2 * n_rules + 1:
            break
        faults.append(best)
        share, known = tried[best]
    return dict(zip(names, share[:, 0].tolist(), strict=True))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns with the counts, the votes, failed and p_good, the posterior probability of good quality, of each row.

    Counts are made in one pass over the texts and written down. Rows that have not failed are then counted by pattern of votes: at
    most 3 to the power of the number of rules patterns reach the driver, whatever the number of rows. A failed row's pattern
    that none of the others has gets 0. A null text counts as empty, and so fails.
    """
    counted = docs.select(*keep, text_counts(F.col(text)).alias("_c")).select(*keep, "_c.*").withColumn("votes", votes(rules))
    counted = written(counted.withColumn("failed", F.expr(FAILED)), "quality")
    patterns = {r["votes"]: r["n"] for r in counted.where("not failed").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior = fit(patterns, len(rules))
    known = F.create_map(*[x for p, v in posterior.items() for x in (F.lit(p), F.lit(v))]) if posterior else F.create_map(F.lit(""), F.lit(0.0))
    return counted.withColumn("p_good", F.coalesce(F.try_element_at(known, F.col("votes")), F.lit(0.0)))
