"""Spelling variants, importance resampling and language mixtures, against plain definitions of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import language, resampling, spelling
from loomgraph.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# spelling variants


def plain_words(rows, least=5, times=3):
    n = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= times}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    out = {}
    for w in n:
        near = [x for x in n if one_apart(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form, None, n[w], len(near), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def got_variants(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(seed, n_docs=300):
    rng = random.Random(seed)
    letters = "abcdeéÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(25)]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems[: rng.randint(1, 25)])
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, rng.choice([" ", ", ", "1", "Œ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_all_pairs(spark, seed, monkeypatch):
    rows = [*misspelt(seed), (None, "Colour colour COLOUR color color"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    want = plain_variants(rows)
    assert len(want) > 100 and any(w[1] != w[0] and w[1] != w[2] for w in want)
    assert got_variants(spelling.variants(docs)) == want
    # several tries, in several passes, with small frames and tasks that hand on often
    for name, small in (("LETTERS", 200), ("SENT", 4000), ("FRAME", 64), ("ABREAST", 50), ("HELD", 20), ("SLICE", 7)):
        monkeypatch.setattr(spelling, name, small)
    assert spelling.tries(spelling.word_counts(docs)).count() > 5
    assert got_variants(spelling.variants(docs)) == want


def test_chains_of_forms_end_at_one_root(spark):
    # each word is one letter longer and twice as frequent as the one before
    words = ["abcde" + "fghijklm"[:i] for i in range(8)]
    rows = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words)]
    rows = [r for r in rows if plain_words([r])]
    want = plain_variants(rows)
    assert got_variants(spelling.variants(spark.createDataFrame(rows, DOCS))) == want
    assert max(Counter(w[2] for w in want).values()) >= 6


def test_odd_rows_and_long_runs_are_words_too(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got_variants(spelling.variants(odd)) == plain_variants(rows)
    assert spelling.variants(none).collect() == []
    long = "ab" * 2_000
    rows = [(i, f"{long} {long[:i]}{long[i + 1:]}" if i % 2 else f"{long}c {long}") for i in range(3, 9)]
    docs = spark.createDataFrame([*rows, *[(i, "x" * 20_000) for i in range(50, 54)]], DOCS)
    got = {(len(w), n, near) for w, _, _, n, near, _ in got_variants(spelling.variants(docs))}
    assert any(size == 20_000 and near == 0 for size, _, near in got) and any(size == 4_000 and near for size, _, near in got)


# importance resampling


def plain_features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resampled(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    s, t, found = Counter(), Counter(), []
    for d, text in rows:
        n, f = plain_features(text, longest)
        found.append((d, n, [x % buckets for x in f]))
        s.update(found[-1][2])
    for text in target:
        t.update(x % buckets for x in plain_features(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    scored = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        scored.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fits = sorted((r for r in scored if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for i, r in enumerate(fits[: percent * len(fits) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, scored), key=str)


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97)])
def test_draws_are_those_of_the_formula(spark, sf, longest, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 40)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "null id " * 12), (3, None), (4, "")], DOCS)).repartition(5)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = resampling.resampled(docs, target, longest=longest, buckets=buckets, percent=30)
    want = plain_resampled([tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()], longest, buckets, 30)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[4] is not None for r in want) > 20


def test_tied_scores_and_odd_rows_are_ranked_across_ranges(spark, odd, none):
    rows = [(7, "the same words again and again " * 5)] * 30 + [(d, "one two three " * 9) for d in range(40)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    target = spark.createDataFrame([("same words",)], "text string")
    got = [tuple(r) for r in resampling.resampled(docs, target, percent=50).collect()]
    assert sorted(got, key=str) == plain_resampled(rows, ["same words"], percent=50)
    odd_rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, resampling.resampled(odd, target, percent=50).collect()), key=str) == plain_resampled(odd_rows, ["same words"], percent=50)
    assert resampling.resampled(none, target).collect() == []
    # without a target the same formula holds
    assert sorted(map(tuple, resampling.resampled(odd, none).collect()), key=str) == plain_resampled(odd_rows, [])


def test_documents_like_the_target_are_drawn(spark):
    rows = [(d, ("river garden stone " if d % 10 == 0 else "ledger invoice tax ") * 30) for d in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = resampling.resampled(docs, spark.createDataFrame([("garden river stone " * 50,)], "text string")).where("rank is not null").collect()
    assert len(got) == 40 and all(r["doc_id"] % 10 == 0 for r in got)


# language mixtures


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_language"](spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in truth[r["doc_id"]][1] or ""))
    held = [r["lang_pred"] == truth[r["doc_id"]][0] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.learned(rows.select("lang", "text"))


@pytest.fixture(scope="module")
def prose(spark):
    """Long enough words of single-language documents, by language."""
    out = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 1500").orderBy("doc_id").collect():
        out.setdefault(r["lang"], []).append(r["text"].split())
    return out


def plain_likelihood(model, word):
    """By the definition: the mean over sizes of the sums of the n-grams' logarithms, one word at a time."""
    from loomgraph.llm.text import Words, words

    w = words([word.lower().encode()], language._INSIDE, lower=False)
    assert isinstance(w, Words)
    found, at, inverse = language.grams(w)
    each = [model.logs[found[at[i] : at[i + 1]]].astype(float).sum(0) / len(language.GRAMS) for i in range(len(at) - 1)]
    return [each[i] for i in inverse]


def plain_mixture(model, text):
    """Expectation-maximisation over single words, and the best of nested sets."""
    each = np.array(plain_likelihood(model, text))
    n = len(each)

    def em(some, share, rounds):
        p = np.exp(each[:, some])
        for _ in range(rounds):
            r = p * share
            share = (r / r.sum(1, keepdims=True)).mean(0)
        return share, np.log((p * share).sum(1)).sum()

    share, _ = em(list(range(each.shape[1])), np.full(each.shape[1], 1 / each.shape[1]), language.ROUNDS)
    order = np.argsort(-share, kind="stable")
    best, chosen = each.sum(0).max(), None
    for size in range(2, len(order) + 1):
        begin = share[order[:size]] + 1e-9
        got, likely = em(list(order[:size]), begin / begin.sum(), language.ROUNDS // 2)
        if likely - language.PENALTY * (size - 1) * math.log(n + 1) <= best:
            break
        best, chosen = likely - language.PENALTY * (size - 1) * math.log(n + 1), dict(zip(order[:size].tolist(), got))
    return chosen or {int(each.sum(0).argmax()): 1.0}


def test_mixtures_are_those_of_single_words(model, prose):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        parts = rng.sample(sorted(prose), rng.choice([1, 2, 3]))
        texts.append(" ".join(w for lang in parts for w in rng.choice(prose[lang])[: rng.randint(5, 120)]))
    got = model.mixtures([t.encode() for t in texts])
    several = 0
    for text, (_, found) in zip(texts, got):
        want = plain_mixture(model, text)
        assert set(dict(found)) == set(want)
        assert all(abs(share - want[i]) < 1e-6 for i, share in found) and abs(sum(dict(found).values()) - 1) < 1e-9
        several += len(found) > 1
    assert several > 10


def test_proportions_of_mixed_documents(model, prose):
    names = sorted(prose)
    for a in names:
        for b in names:
            if a != b:
                text = " ".join(prose[a][0][:210] + prose[b][0][:90])
                (_, found), = model.mixtures([text.encode()])
                share = {model.names[i]: s for i, s in found}
                assert set(share) == {a, b} and abs(share[a] - 0.7) < 0.16, (a, b, share)
    # whole documents in one language stay so, nearly all of them
    alone = [len(f) == 1 for lang in names for _, f in model.mixtures([" ".join(w).encode() for w in prose[lang]])]
    assert np.mean(alone) > 0.95


def test_candidates_and_parts_do_not_change_what_is_found(model, prose, monkeypatch):
    texts = [" ".join(prose[a][1][:200] + prose[b][1][:150]).encode() for a in prose for b in prose]
    whole = model.mixtures(texts)
    monkeypatch.setattr(language, "CANDIDATES", 3)
    assert [[i for i, _ in f] for _, f in model.mixtures(texts)] == [[i for i, _ in f] for _, f in whole]
    from loomgraph.llm import text

    monkeypatch.setattr(text, "CHUNK", 300)
    assert [[i for i, _ in f] for _, f in model.mixtures(texts)] == [[i for i, _ in f] for _, f in whole]


def test_odd_rows_have_a_language_or_none(spark, odd, none):
    rows = [(d, t, lang) for d, t, lang in ((1, "le chat noir", "fr"), (2, "the black cat", "en"), (3, "the dog", "en"), (4, None, "de"), (5, "xyz", None))]
    learned = language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert learned.names == ["en", "fr"]
    texts = [(1, "the cat"), (2, "chat noir"), (3, None), (4, ""), (5, "123 !? ²"), (6, "中文"), (None, "noir noir"), (1, "the cat")]
    got = {(r["doc_id"], r["lang_pred"]) for r in language.languages(spark.createDataFrame(texts, DOCS), learned).collect()}
    assert got == {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "fr")}
    assert language.learned(none) is None
    assert {r["lang_pred"] for r in language.languages(odd, None).collect()} == {"und"}
    found = language.identified(odd)
    assert found.count() == odd.count() and language.identified(none).collect() == []
