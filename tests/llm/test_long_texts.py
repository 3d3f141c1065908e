"""One text of 16 MB, and one of 2 MB without a space, through each operator's work on texts: it ends, and in bounded memory."""

import subprocess
import sys
from pathlib import Path

import pytest

SETUP = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from barloom.llm import language, pieces, ppm, quality_rules, secret_scan, simhash, suffix_dedup, unigram, windows, words
rng = np.random.default_rng(0)
vocabulary = ["".join(rng.choice(list("etaoinshrdluéä"), int(rng.integers(1, 9)))) for _ in range(5000)]
some = rng.choice(vocabulary, 100_000)
text = {text}
texts = pa.array([text, "short"])
v = pieces.vocabulary()
chance = np.random.default_rng(1).random((len(v.pieces), 2))
model = language.LanguageModel(("a", "b"), chance / chance.sum(0))
codec, tools, scanner = unigram.Codec.load(), model.tools(), secret_scan.Scanner()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{work}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, len(text.encode()) / 2**20)
"""
TEXTS = {"words": '" ".join(rng.choice(some, 2_900_000)) + "\\n"', "no spaces": '"".join(rng.choice(some, 400_000))'}
WORK = {
    "pieces": "ids = codec.encode(texts); assert next(codec.spelled(ids)) == text.encode()",
    "language": "assert all(np.isfinite(model.logarithms(part, *tools)[0]).all() for part in words.slices(texts, language.SLICE))",
    "quality": "assert sum(quality_rules.counted(part)[0].sum() for part in words.slices(texts, quality_rules.SLICE)) == len(text.split()) + 1",
    "simhash": "assert all(len(simhash.prints(part, 5, 6)) for part in words.slices(texts, simhash.SLICE))",
    "secrets": "assert isinstance(scanner.spans(text), list)",
    "runs": "assert sum(len(windows.runs(data, offsets, 200, again=True)[0]) for _, data, offsets, _ in suffix_dedup.parts_of(texts, 200, suffix_dedup.PIECE)) > 1000",
    "grams": "assert sum(ppm.counted_grams(part, 5)[1].sum() for part in words.slices(texts, ppm.SLICE)) > len(text)",
}


@pytest.mark.parametrize("kind", TEXTS)
@pytest.mark.parametrize("name", WORK)
def test_memory(name, kind):
    code = SETUP.format(root=str(Path(__file__).parents[2]), text=TEXTS[kind], work=WORK[name])
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    more, size = map(float, done.stdout.split())
    assert more <= 64 + 40 * size, (more, size)


def test_many_secrets():
    """Time grows with the text: 4 MB of assignments, and of keys in one long string, are scanned in a few times the time of 1 MB."""
    import time

    from barloom.llm.secret_scan import Scanner

    scanner = Scanner()
    for line in ("password=abcdefgh00000000 ", "aB3dE5fG7hI9jK1lM2nO4pQ6/example/", "token=aB3dE5fG7hI9jK1lM2nO4pQ6 and " + "0f" * 20 + "."):
        took = []
        for size in (1 << 18, 1 << 20):
            text = line * (size // len(line))
            began = time.process_time()
            assert len(scanner.spans(text)) >= size // len(line)
            took.append(time.process_time() - began)
        assert took[1] <= 8 * took[0] + 1, (line, took)
