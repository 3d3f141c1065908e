"""The Jaccard join, spelling variants and lexical search against brute force, on awkward rows and on random ones."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import jaccard, lexical, variants

SCHEMA = "doc_id long, text string, score double, component long, item string, n long, token long"
BASE = " ".join(f"w{i}" for i in range(200))
TEXTS = [
    None, "", " \n\t", "one", "ONE", "one two three four", "one  two\nthree four", "one two three four five", "one two three four five six", BASE, BASE.upper(), BASE.replace("w50 ", "x50 "), BASE.replace("w50 ", "x50 ").replace("w150 ", "x150 "),
    " ".join(f"w{i}" for i in range(20, 200)), " ".join(f"w{i}" for i in range(60, 200)), "a b c d e a b c d e a b c d e", "a b c d e a b c d e", "é   ü ñ ö", "x" * 5000, "word " * 3000, BASE, "same words here twice over", "same words here twice over",
    "straße Straße STRASSE ÀÉÎ×÷ naïve naive naïvely-naively", "\x00 nul\x00nul",
]


def random_texts(seed, n):
    """Texts that copy one another with edits, so that similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = out[rng.integers(len(out))].split() if out and rng.random() < 0.8 else [f"v{x}" for x in rng.integers(0, 60, rng.integers(1, 300))]
        for _ in range(rng.integers(0, 1 + len(words) // 30)):
            words[rng.integers(len(words))] = f"v{rng.integers(0, 60)}"
        cut = rng.integers(0, 1 + len(words) // 12)
        out.append(" ".join([*words[cut:], *[f"v{x}" for x in rng.integers(0, 60, rng.integers(0, 5))]]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1.0, 7, "i", 3, 5) for i, t in enumerate(TEXTS)] + [(None, BASE, *[None] * 5)], SCHEMA).repartition(3).cache()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_jaccard(spark, docs):
    rows = jaccard.similar(docs).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in rows}
    assert got.pop(None) == (196, None) and len(rows) == len(TEXTS) + 1
    want = brute_components(TEXTS)
    assert got == want and want[10] == want[11] == want[12] == (196, 9) and want[14][1] == 14
    assert jaccard.similar(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE)], "doc_id long, text string")
    assert sorted(r["component"] for r in jaccard.similar(twice).collect()) == [1, 1, 1]


@pytest.mark.parametrize(("tile", "cell", "repeats"), [(jaccard.TILE, jaccard.CELL, jaccard.REPEATS), (1500, 4, 3)])
def test_jaccard_on_random_texts(spark, monkeypatch, tile, cell, repeats):
    """Also with frequent shingles, tiles and cells that small tables have none of otherwise."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "REPEATS", repeats)
    monkeypatch.setattr(jaccard.tiled, "__defaults__", (tile,))
    texts = random_texts(3, 250)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in jaccard.similar(rows).collect()}
    want = brute_components(texts)
    assert got == want and 20 < len({c for _, c in want.values()}) < 230


def test_tree_by_brute_force():
    """Links of sets in one tree, many sizes and groups, on the threshold too."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        k, universe = int(rng.integers(1, 60)), int(rng.integers(5, 400))
        group = np.sort(rng.integers(0, 4, k))
        sets, seen = [], set()
        for g in group.tolist():
            while True:
                if sets and rng.random() < 0.7:
                    s = set(sets[rng.integers(len(sets))])
                    for _ in range(rng.integers(0, 1 + len(s) // 6)):
                        s ^= {int(rng.integers(universe))}
                else:
                    s = set(rng.integers(0, universe, rng.integers(1, universe)).tolist())
                if s and (g, key := tuple(sorted(s))) not in seen and (g, tuple(sorted(s))) not in seen:
                    seen.add((g, key))
                    break
                universe += 1
            sets.append(s)
        label = np.random.default_rng(2).integers(1, 2**63, universe + 1, dtype=np.uint64)
        hashes = [np.sort(label[sorted(s)]) for s in sets]
        offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        flat = np.concatenate(hashes)
        got = jaccard.joined(flat, offsets, group, flat % np.uint64(3) == 0)
        root = list(range(k))
        for i in range(k):
            for j in range(i):
                if group[i] == group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        assert got.tolist() == root


def brute_words(rows, modulus=199):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, modulus=199):
    n = brute_words(rows, modulus)
    out = {}
    for w in n:
        some = [x for x in n if near(w, x)]
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = [w, form, None, n[w], len(some), n[form] if form else None]
    for w, row in out.items():
        while out[w][1]:
            w = out[w][1]
        row[2] = w
    return sorted(tuple(x) for x in out.values())


def variant_rows(seed=0):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abécñ"), rng.integers(5, 9))) for _ in range(40)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = stems[min(39, int(rng.exponential(6)))]
            k = int(rng.integers(0, len(w)))
            u = rng.random()
            words.append(w[:k] + w[k + 1 :] if u < 0.03 else w[:k] + "ÿ" + w[k:] if u < 0.06 else w[:k] + "a" + w[k + 1 :] if u < 0.1 else w.upper() if u < 0.2 else w)
        rows.append((i, " ".join(words) if i % 7 else "-".join(words)))
    return [*rows, (None, "aaaaaaa " * 9), (500, None), (501, ""), (502, "x" * 3000), (503, "chainaa " * 130 + "chainab " * 26 + "chaincb " * 5)]


def test_variants(spark, docs, monkeypatch):
    rows = variant_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ("word", "form", "root", "n", "n_near", "form_n")
    as_rows = lambda d: sorted(tuple(r[c] for c in names) for r in d.collect())
    key = lambda rows: sorted(rows, key=lambda x: x[0])
    want = brute_variants(rows)
    assert key(as_rows(variants.spelling_variants(df))) == key(want)
    assert any(x[1] for x in want) and any(x[2] != x[0] and x[2] != x[1] for x in want) and len(want) > 100
    monkeypatch.setattr(variants, "SHARD", 17)
    monkeypatch.setattr(variants, "STATES", 100)
    assert key(as_rows(variants.spelling_variants(df, modulus=29))) == key(brute_variants(rows, 29))
    assert variants.spelling_variants(docs.limit(0)).count() == 0
    variants.spelling_variants(docs).collect()


def brute_search(rows, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low(t))
    docs = [(i, c) for i, t in rows if (c := collections.Counter(terms(t)))]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(x for _, c in docs for x in c)
    out = []
    for item, text in items:
        q, found = collections.Counter(terms(text)), []
        for i, c in docs:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            score = sum(qf * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 8 * m)) for x, qf in q.items() if x in c)
            found += [(-score, i is None, i)] if score > 0 else []
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [lexical.BLOCK, 150])
def test_search(spark, docs, block, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(80)] + ["été", "Ünï", "漢字"]
    some = lambda n: " ".join(words[min(82, int(rng.exponential(15)))] for _ in range(n))
    rows = [(i, some(int(rng.integers(0, 80)))) for i in range(300)] + [(300 + i, t) for i, t in enumerate(TEXTS)] + [(None, "t79 t78 t77"), (900, "t3"), (899, "t3")]
    items = [(i, some(int(rng.integers(1, 30)))) for i in range(25)] + [(25, None), (26, ""), (27, "t3 t3 T3"), (28, "unknown terms"), (29, "été t79-t78"), (30, "nul")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    it = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    monkeypatch.setattr(lexical, "EXPANDED", 500)
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(df, it, block=block).collect())
    assert got == brute_search(rows, items) and len(got) > 200
    named = docs.withColumnRenamed("component", "rank")
    assert lexical.search(named, it).count() >= 0 and lexical.search(df.limit(0), it).count() == 0 and lexical.search(df, it.limit(0)).count() == 0


def test_first_of_each():
    kept = lexical.first_of_each(np.array([1, 0, 1, 1, 0]), np.array([5, 1, 7, 6, 2]), 2)
    assert sorted(kept.tolist()) == [1, 2, 3, 4]
    assert [x for names, *_ in lexical.terms_of(pa.array(["Ab-cd é_é", None])) for x in names.to_pylist()] == [b"ab", b"cd", "é".encode()]
