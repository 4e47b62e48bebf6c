"""Texts of 100 MB, and a word of that length, in a process of their own whose memory is measured."""

import subprocess
import sys

CODE = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
from loomgraph.llm import line_dedup, quality, text, toxicity

rng = np.random.default_rng(1)
if {giant}:
    data = b"x" * 100_000_000
else:
    one = b" ".join(b"w%d" % i for i in rng.integers(0, 50_000, 200_000))
    data = one.replace(b"7 ", b". ") * (100_000_000 // len(one)) + b"idiot"
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if {name!r} == "quality":
    m = quality.train([("good words here and there", 1), ("BAD!! BAD!! BAD!!", 0)] * 5, {{0: 5, 1: 5}})
    assert 0 <= m.scores([b"a", data])[1] <= 1
elif {name!r} == "toxicity":
    m = toxicity.train([("you idiot of a man", 1), ("a plain man", 0)] * 20, {{0: 20, 1: 20}})
    assert {giant} or m.scores([data])[0] > m.scores([b"plain"])[0]
elif {name!r} == "shingles":
    assert len(text.shingles([data, b"a"], 5, text.NOT_SPACE)[0]) == (1 if {giant} else len(text.shingles([one.replace(b"7 ", b". ") * 2 + b"idiot"], 5, text.NOT_SPACE)[0]))
else:
    begin, _, hashed, words, starts = line_dedup.lines([data])
    assert words.sum() == (1 if {giant} else 200_000 * (100_000_000 // len(one)) - (100_000_000 // len(one)) + 1)
    line_dedup.windows(hashed, words, starts, 20)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def grown(name, giant):
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, name=name, giant=giant)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return float(done.stdout)


def test_memory_is_bounded_by_the_slice():
    found = {(n, g): grown(n, g) for n in ("quality", "toxicity", "shingles", "lines") for g in (False, True)}
    assert max(found.values()) < 900, found
