import collections
import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import fingerprint
from loomgraph.llm.queries import QUERIES


def test_query_edits(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = QUERIES["op8_fingerprint"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = {r["doc_id"]: r for r in df.collect()}
    order = sorted(texts, reverse=True)
    wins = 0
    for i, k in enumerate(order):
        n = len(texts[k])
        half = n // 2
        edited = texts[k][: n - half] + texts[order[(i + 1) % len(order)]][:half]
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[k]["n_chars"] == n
        assert 0 <= rows[k]["near_edited"] <= 1 and 0 <= rows[k]["near_next"] <= 1
        wins += rows[k]["near_edited"] >= rows[k]["near_next"]
    assert wins > 0.95 * len(order)
    prints = {}
    for k, r in rows.items():
        assert prints.setdefault(texts[k], r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)


def test_multisets(spark):
    rows = [("a", "one two\nthree four\nthree four"), ("b", "three four\none two\nthree four"), ("c", "one two\nthree four"), ("d", "three four"), ("e", ""), ("f", "one  two\nthree four\nthree four")]
    v = fingerprint.fingerprints(spark.createDataFrame(rows, "k string, text string"), "text", ["k"])
    got = {r["k"]: r["vector"] for r in v.collect()}
    assert got["a"] == got["b"] != got["c"] and got["a"] != got["f"] and got["e"] != got["d"]
    pair = lambda x, y, s: v.where(F.col("k") == x).crossJoin(v.where(F.col("k") == y).select(F.col("vector").alias("w"))).select(fingerprint.combined(F.col("vector"), F.col("w"), s).alias("v")).first()["v"]
    assert pair("c", "d", 1) == got["a"] and pair("a", "d", -1) == got["c"]


MASK = 0xFFFFFFFF


def seeded(k, data):
    return xxhash.xxh64_intdigest(data, xxhash.xxh64_intdigest(struct.pack("<i", k), 42))


def naive(text):
    """The vector by its definition."""
    wide, signs = [0] * fingerprint.WIDE, [0] * fingerprint.SIGNS
    for paragraph in text.split("\n"):
        for k in range(fingerprint.WIDE // 2):
            h = seeded(k, paragraph.encode())
            wide[2 * k] += h & MASK
            wide[2 * k + 1] += h >> 32
    pieces = []
    for paragraph in text.split("\n"):
        words = [m for m in re.finditer(r"[^ \t\x0b\x0c\r]+", paragraph)]
        for i in range(0, len(words), 8):
            begin = 0 if i == 0 else words[i].start()
            last = words[min(i + 7, len(words) - 1)]
            pieces.append(paragraph[begin : last.end()])
    for piece in pieces:
        for k in range(fingerprint.SIGNS // 64):
            h = seeded(100 + k, piece.encode())
            for i in range(32):
                signs[32 * k + i] += h >> i & 1
                signs[fingerprint.SIGNS // 2 + 32 * k + i] += h >> (32 + i) & 1
    return [x & MASK for x in wide] + signs + [len(pieces)]


def shown(v):
    return "".join(f"{x:08x}" for x in v[: fingerprint.WIDE]) + hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()[:32]


def alike(a, b):
    x, y = ([2 * s - v[-1] for s in v[fingerprint.WIDE : -1]] for v in (a, b))
    whole = sum(p * p for p in x) + sum(p * p for p in y)
    return 1.0 if a == b else max(0.0, min(1.0, 2 * sum(p * q for p, q in zip(x, y)) / whole)) if whole else 0.0


def test_vectors_and_likeness_against_their_definition(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in rows}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprint"](spark, sf).collect()}
    for i, k in enumerate(order[:60]):
        after = texts[order[(i + 1) % len(order)]]
        half = len(texts[k]) // 2
        own, edited, follows = naive(texts[k]), naive(texts[k][: len(texts[k]) - half] + after[:half]), naive(after)
        assert got[k]["fingerprint"] == shown(own) and got[k]["edited_fingerprint"] == shown(edited)
        assert abs(got[k]["near_edited"] - alike(own, edited)) < 1e-9 and abs(got[k]["near_next"] - alike(own, follows)) < 1e-9


def test_hot_ids_and_rows_without_id(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(d, f"text {d} " + "y" * rng.randrange(9)) for d in range(30)] + [(7, f"seven {i}") for i in range(40)] + [(20, "same")] * 30 + [(None, f"alone {i % 3}") for i in range(20)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: (-r[0], -signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = collections.Counter((d, hashlib.sha256(mixed(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    want += collections.Counter((None, hashlib.sha256(mixed(t, t).encode()).hexdigest()) for d, t in rows if d is None)
    for runs, hot in ((512, 1000), (8, 1), (20, 1), (3, 1)):
        monkeypatch.setattr(fingerprint, "RUNS", runs)
        monkeypatch.setattr(fingerprint, "HOT_ROWS", hot)
        monkeypatch.setattr(fingerprint, "parts", lambda s: 1)
        got = fingerprint.edited_fingerprints(docs).collect()
        assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
        assert all(r["near_next"] == 1.0 for r in got if r["doc_id"] is None)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def mixed(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def test_awkward_rows(odd, none, spark):
    got = fingerprint.edited_fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_chars"] == 0 and by[2]["fingerprint"] == by[3]["fingerprint"] and by[2]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[0]["fingerprint"] == by[1]["fingerprint"] and by[1]["near_next"] == 1.0
    # nine has two rows: the first one's next is the second, the second one's next is eight
    assert sorted(round(r["near_next"], 3) for r in got if r["doc_id"] == 9)[1] == 1.0
    assert fingerprint.edited_fingerprints(none).count() == 0
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
