import math
import re
import zlib

import numpy as np

from loomgraph.llm import quality, text, toxicity
from loomgraph.llm.queries import QUERIES


def accuracy(spark, name, column, sf="/root/testdata/sf0.01"):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    by, rest = (5, 0) if column == "toxic" else (3, 1)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % by == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean([p == y for p, y in held]), held


def test_quality_on_held_out_rows(spark):
    assert accuracy(spark, "op5_quality", "quality")[0] > 0.9


def test_toxicity_on_held_out_rows(spark):
    score, held = accuracy(spark, "op7_toxicity", "toxic")
    assert score > 0.9 and np.mean([p for p, y in held if y == 0]) < 0.05


def labelled(column, sf, by, rest):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text, {column} FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) WHERE {column} IN (0, 1) ORDER BY doc_id").fetchall()
    return [(t or "", y) for d, t, y in rows if (zlib.crc32(str(d).encode()) % by == rest) is False]


def test_counterfactuals_change_the_model_of_documents_and_calm_neutral_mentions():
    rows = labelled("toxic", "/root/testdata/sf0.01", 5, 0)
    counts = {c: sum(y == c for _, y in rows) for c in (0, 1)}
    free, fair = toxicity.train(rows, counts, fair=0.0), toxicity.train(rows, counts)
    assert fair.pairs > len(rows) and not np.allclose(free.weights, fair.weights)
    clean = [t.encode() for t, y in rows if y == 0][:50]
    terms = [t.encode() for kind in toxicity.IDENTITY for t in kind]
    moved = lambda m: np.mean([np.abs(m.logits([c + b" " + t for c in clean]) - m.logits(clean)).mean() for t in terms])
    assert moved(free) > 0.001 and moved(fair) < 0.1 * moved(free)
    flips = lambda m: sum(int(((m.scores([c + b" " + t for c in clean]) >= 0.5) & (m.scores(clean) < 0.5)).sum()) for t in terms)
    assert flips(fair) <= flips(free) and flips(fair) == 0


def test_a_mention_in_toxic_company_is_no_evidence():
    filler = [f"some plain words number {i} about gardens and rivers" for i in range(40)]
    rows = [(f"{f} the women said idiot", 1) for f in filler[:20]] + [(f"{f} the women met", 1) for f in filler[20:30]] + [(f"{f} the men met", 0) for f in filler] + [(f, 0) for f in filler]
    counts = {0: 80, 1: 30}
    gap = lambda m: abs(np.diff(m.logits([b"the women met", b"the men met"]))[0])
    free, fair = toxicity.train(rows, counts, fair=0.0), toxicity.train(rows, counts, fair=50.0)
    assert gap(fair) < 0.3 * gap(free)
    assert fair.scores([b"you idiot"])[0] > fair.scores([b"you friend"])[0]
    # a text that names a term gives swaps of that term, in all places
    made = list(toxicity.counterfactuals([b"Women and women, not womenfolk"], [1]))
    assert {(b, t) for b, t, _ in made} == {(b" and , not womenfolk", b"women")} and len(made) == toxicity.SWAPS
    assert [o for _, _, o in toxicity.counterfactuals([b"none named"], [0])][-1] == b""


MASK = (1 << 64) - 1
AWKWARD = [b"", b" \n", b"One one ONE one!", "\u00e4\u00f6 \u4e2d\u6587 \U0001f600 x".encode(), b"a" * 5000, b"b " * 3000, b"idiot\x00idiots\nIDIOT ", b"%%% ***" * 9, b"tail idiot"]


def scrambled(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(data, length=None):
    base, power, total = text._BASE, 1, 0
    for b in data:
        total, power = total + (b + 1) * power, power * base & MASK
    return scrambled((total & MASK) + (len(data) if length is None else length) & MASK)


def test_quality_scores_against_a_naive_scorer(monkeypatch):
    rows = labelled("quality", "/root/testdata/sf0.001", 3, 1)
    model = quality.train(rows, {c: sum(y == c for _, y in rows) for c in (0, 1)})

    def naive(t):
        words = re.findall(rb"[^\x20\x09-\x0d]+", t)
        found = [quality.BUCKETS for x, y in zip(words, words[1:]) if x == y]
        for w in words:
            framed = b"\x01" + w + b"\x01"
            found.append((hashed(framed, 0) >> 40) % quality.BUCKETS)
            found += [(hashed(framed[i : i + n], n) >> 40) % quality.BUCKETS for n in quality.GRAMS for i in range(len(framed) - n + 1)]
        mean = sum(float(model.weights[f]) for f in found) / max(1, len(found))
        return 1 / (1 + math.exp(-max(-30, min(30, model.bias + mean))))

    texts = [t.encode() for t, _ in rows][:40] + AWKWARD
    want = [naive(t) for t in texts]
    assert np.allclose(model.scores(texts), want, atol=1e-5)
    monkeypatch.setattr(text, "CHUNK", 6000)
    assert np.allclose(model.scores(texts), want, atol=1e-5)


def test_toxicity_scores_against_a_naive_scorer(monkeypatch):
    rows = labelled("toxic", "/root/testdata/sf0.01", 5, 0)
    model = toxicity.train(rows, {c: sum(y == c for _, y in rows) for c in (0, 1)})
    known = dict(zip(model.features.words.tolist(), model.weights))
    grams = dict(zip(model.features.grams.tolist(), model.weights[len(known) :]))

    def naive(t):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in t)
        words = set(re.findall(rb"[a-z0-9\x80-\xff]+", low))
        pieces = {f[i : i + 4] for w in words for f in [b" " + w + b" "] for i in range(len(f) - 3)}
        # the place after a word of one letter, or before the next one, is within the n-gram of two words
        plain = b" " + re.sub(rb"[^a-z0-9\x80-\xff]", b" ", low) + b"   "
        pieces |= {plain[i : i + 4] for i in range(len(plain) - 3) if plain[i + 1] != 32 and plain[i + 2] != 32}
        total = model.bias + sum(known.get(hashed(w), 0) for w in words) + sum(grams.get(int.from_bytes(p, "little"), 0) for p in pieces)
        return 1 / (1 + math.exp(-max(-30, min(30, total))))

    texts = [t.encode() for t, _ in rows][:60] + AWKWARD
    want = [naive(t) for t in texts]
    assert np.allclose(model.scores(texts), want) and len(grams) > 10
    monkeypatch.setattr(text, "CHUNK", 6000)
    assert np.allclose(model.scores(texts), want)


def test_without_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(odd, empty).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.toxicity(odd, empty).collect()} == {0}
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (4, None, None), (6, 0, 1), (7, 1, 0), (8, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.quality, toxicity.toxicity):
        assert f(odd, labels).count() == odd.count() and f(none, labels).count() == 0
    kept = toxicity.accepted(odd, empty)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_a_score_depends_on_the_text_alone():
    model = quality.train([("good words here and there", 1), ("BAD!! BAD!! BAD!!", 0)] * 5, {0: 5, 1: 5})
    one = model.scores([b"good words here"])[0]
    assert model.scores([b"BAD!!", b"", b"good words here"])[2] == one and model.scores([b""])[0] == model.scores([b" \n"])[0]
