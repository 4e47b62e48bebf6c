import random
import re

import numpy as np

from loomgraph.llm import near_dedup
from loomgraph.llm.components import components
from loomgraph.llm.queries import QUERIES


def brute(docs, size=5, percent=75):
    sets = {}
    for d, t in docs:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(d for d in sets if sets[d])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(seed=5, n=60):
    """Chains of edited copies around the threshold, with a passage that all share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(160)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(0, 14)):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.3:
            base = text
        out.append((i, " ".join(text)))
    out += [(n + i, " ".join(passage + [word() for _ in range(30)])) for i in range(30)]
    return out


def test_a_chain_at_the_threshold(spark):
    docs = family()
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    for r in QUERIES["op9_minhash"](spark, sf).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_awkward_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == 0 and not by[1]["kept"]
    for empty in (2, 3, 5):
        assert by[empty]["n_shingles"] == 0 and by[empty]["component_id"] == empty and by[empty]["kept"]
    assert by[4]["n_shingles"] == 1 and by[8]["n_shingles"] == 1 and by[9]["component_id"] == 9
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 9]


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for similarity in (0.75, 0.9):
        n = int(2000 * 2 * similarity / (1 + similarity))
        y = np.concatenate([x[:n], rng.integers(0, 2**63, 2000 - n, dtype=np.uint64)])
        s = near_dedup.odd_sketch(near_dedup.minhash([x, y], near_dedup.SAMPLES, 1)).view(np.uint64)
        assert int(np.bitwise_count(s[0] ^ s[1]).sum()) <= near_dedup.most_odd_bits(0.75)
    far = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    s = near_dedup.odd_sketch(near_dedup.minhash([x, far], near_dedup.SAMPLES, 1)).view(np.uint64)
    assert int(np.bitwise_count(s[0] ^ s[1]).sum()) > near_dedup.most_odd_bits(0.75)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    assert {r["label"] for r in components(edges).where("node < 50").collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_low_limits_give_the_same(spark, monkeypatch):
    """Shuffled joins in place of broadcasts, small squares, and no round of pivots: what large tables meet."""
    from loomgraph.llm import components as components_

    docs = family(7, 40)
    want, df = brute(docs), spark.createDataFrame(docs, "doc_id long, text string")
    for module, name, value in ((near_dedup, "SQUARE", 7), (near_dedup, "PIVOTS", 0), (near_dedup, "BROADCAST_SKETCHES", 0), (near_dedup, "BROADCAST_IDS", 0), (near_dedup, "BROADCAST_LABELS", 0), (components_, "BROADCAST_LABELS", 0)):
        monkeypatch.setattr(module, name, value)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == want
    assert {r["doc_id"] for r in near_dedup.deduplicated(df).collect()} == {c for _, c in want.values()}
