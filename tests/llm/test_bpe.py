import base64
import hashlib
import random

import numpy as np
import pytest

from loomgraph.llm import bpe
from loomgraph.llm.queries import QUERIES, ranks_path


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    with open(ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(encoding):
    rng = random.Random(3)
    parts = ["'", "s", "re", "'ll", " ", "  ", "\n", "\t", "\u00a0", "é", "ß", "1", "²", "中", "😀", "!", "\0", "\x1c", "\x85", "'S", "_", "\u0301", "क्", "\r\n", "x" * 9]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "a" * 3000, "ab" * 300, "  ", "<|endoftext|>"]
    coder = bpe.Coder(ranks_path())
    ids, sizes = coder.encode(texts)
    ends = np.cumsum(sizes)
    for t, e, s in zip(texts, ends, sizes):
        assert ids[e - s : e].tolist() == encoding.encode_ordinary(t)
    assert [x.decode() for x in coder.decode(ids, sizes)] == texts


def test_long_texts_in_parts(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 7)
    coder = bpe.Coder(ranks_path(), bpe.Limits(50, 20, 3))
    texts = ["it 's  a long\n text, isn't it? " * 20, "x" * 300, "", " 'll" * 99, "a  b" * 70]
    ids, sizes = coder.encode(texts)
    ends = np.cumsum(sizes)
    for t, e, s in zip(texts, ends, sizes):
        assert "".join(bpe.cuts(t, 50)) == t and ids[e - s : e].tolist() == encoding.encode_ordinary(t)
    assert [x.decode() for x in coder.decode(ids, sizes)] == texts


def test_both_forms_of_the_query(encoding):
    """Long pieces, too: in place, all occurrences of a pair in a round."""
    rng = random.Random(7)
    coder = bpe.Coder(ranks_path())
    words = [" unbelievable", "aaaaaaaa", "übergrößen", "ab" * 40, *("".join(rng.choice(a) for _ in range(n)) for a in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "äöüé") for n in (2, 9, 150, 400))]
    for word in words:
        want = encoding._encode_single_piece(word)
        for sql in (bpe.ENCODE_SQL, bpe.LONG_SQL):
            ids, sizes = coder.by_rows([word.encode()], sql)
            assert ids.tolist() == want and sizes.tolist() == [len(want)]
    both, sizes = coder.by_rows([w.encode() for w in words], bpe.LONG_SQL)
    assert both.tolist() == [i for w in words for i in encoding._encode_single_piece(w)]
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(5000))
    assert coder.by_rows([long.encode()], bpe.LONG_SQL)[0].tolist() == encoding._encode_single_piece(long)


def test_ranks_in_any_order(tmp_path):
    """A vocabulary whose ranks are no order of merges, and beyond 65,536: tokens that open pairs of lower rank."""
    import tiktoken

    rng = random.Random(11)
    for n in range(6):
        ranks = {bytes([i]): i for i in range(256)}
        made = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(60)]
        numbers = rng.sample(range(256, 200_000), 60)
        ranks |= {m: k for m, k in zip(dict.fromkeys(made), numbers)}
        path = tmp_path / f"{n}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(b) + b" %d\n" % i for b, i in ranks.items()))
        library, coder = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={}), bpe.Coder(str(path))
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(2, 60)))
            for sql in (bpe.ENCODE_SQL, bpe.LONG_SQL):
                assert coder.by_rows([word.encode()], sql)[0].tolist() == library._encode_single_piece(word)


def test_awkward_rows(odd, none, encoding):
    got = bpe.round_trip(odd, ranks_path()).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in got:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.round_trip(none, ranks_path()).count() == 0
    both = bpe.decode(bpe.encode(odd, ranks_path()), ranks_path())
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both.collect()) and "keys" in both.columns


def test_query(spark, sf, encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe"](spark, sf).collect():
        assert r["n_tokens"] == len(encoding.encode_ordinary(texts[r["doc_id"]] or ""))


def test_long_pieces_are_joined_from_parts_as_the_library_encodes_them():
    import random
    import string
    import time

    import tiktoken

    coder = bpe.Coder(ranks_path())
    library = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(12)
    syllables = [w.decode() for w in coder.ranks if len(w) > 3 and w.isalpha()]
    kinds = [
        lambda n: "".join(rng.choice("ab") for _ in range(n)), lambda n: "".join(rng.choice(string.ascii_letters) for _ in range(n)), lambda n: "".join(rng.choice(syllables) for _ in range(n // 5)),
        lambda n: rng.choice(["a", "ab", "the", "=", "entheren"]) * n, lambda n: "".join(rng.choice("äöüéñ中文字пр") for _ in range(n)), lambda n: "".join(rng.choice("entrhaioul") for _ in range(n)),
    ]
    for kind in kinds:
        for n in (201, 202, 400, 1000):
            word = kind(n)
            assert coder._joined(word.encode()).tolist() == library.encode(word), word
    word = "".join(rng.choice(string.ascii_letters) for _ in range(200_000))
    began = time.perf_counter()
    got = coder._joined(word.encode()).tolist()
    assert time.perf_counter() - began < 30 and got == library.encode(word)
