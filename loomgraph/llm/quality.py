"""A supervised quality classifier on subword embeddings.

Words and their character n-grams are hashed into buckets; each bucket has a learned vector. A document is the mean of
the vectors of all its features, and a softmax layer gives two classes. Vectors and layer are trained together by
stochastic gradient descent in numpy. As both steps after the lookup are linear, a trained model comes down to one
number for each bucket, and a document's score to a mean over its features, so whole texts are scored at the cost of
hashing their distinct words.

Training takes at most ``MOST`` labelled texts of each class, weighted so that classes count as they do among all
labels. Labels, lang, source and doc_id are no features.

Of pairs of words, only whether both are the same is a feature, with a vector of its own: pairs hashed each for itself
made held-out accuracy worse (0.958 instead of 0.999 on the synthetic documents).

Defined cases: a null text is an empty one; texts without words get the score of the bias alone; a text is worked on in
parts, cut between words, and a word of more than ``CHUNK`` bytes counts as several; repeated rows get equal scores, as
a score depends on the text alone, and 0.5 is predicted as 1; a doc_id with labels that differ is not learned from;
without labels of both classes every score is 0.5; an empty table gives no rows; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, trim
from .labelled import remainder, sample
from .text import NOT_SPACE, Words, chunks, hashes, parted, sums, words

#: Labelled texts of each class that a model is fitted on at most.
MOST = 2000
#: Hash buckets of words and n-grams; one more, of word pairs, stands for any word that repeats the one before.
BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 0.5


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(40)).astype(np.int64) % BUCKETS


def _subwords(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' features: bucket of each feature, where each word's begin (one more than words), and each word's index."""
    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    begin, end = w.begin[first], w.end[first]
    size = end - begin + 2
    stop = np.cumsum(size)
    start = stop - size
    data = np.full(int(stop[-1]) if len(stop) else 0, 1, np.uint8)
    inner = np.repeat(begin - start - 1, size) + np.arange(len(data))
    body = np.ones(len(data), bool)
    body[start], body[stop - 1] = False, False
    data[body] = w.data[inner[body]]
    values = data.astype(np.uint64) + np.uint64(1)
    places, owners = [], []
    word = np.arange(len(first))
    for n in (0, *GRAMS):
        if n:
            count = np.maximum(size - n + 1, 0)
            at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            till, owner = at + n, np.repeat(word, count)
        else:
            at, till, owner = start, stop, word
        places.append(_bucket(hashes(sums(values, at, till), np.full(len(at), n))))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(places)[order], np.searchsorted(owner[order], np.arange(len(first) + 1)), inverse


def _bags(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Features of the texts, part by part: buckets of the distinct words' features, where each word's begin, the word at
    each place and its text; and the text of each pair of neighbours that are the same word."""
    open_, last = -1, np.zeros(0, np.uint64)
    for owners, block in parted(texts, NOT_SPACE, whole=False):
        w = words(block, NOT_SPACE, lower=False)
        owner = np.array(owners)
        text = np.repeat(owner, np.diff(w.starts))
        if len(w.hashes):
            places, at, inverse = _subwords(w)
            # the last word of a part is the neighbour of the next part's first
            follows = bool(len(last)) and int(text[0]) == open_
            line, whose = (np.concatenate([last, w.hashes]), np.concatenate([[open_], text])) if follows else (w.hashes, text)
            again = (whose[1:] == whose[:-1]) & (line[1:] == line[:-1])
            yield places, at, inverse, text, whose[1:][again]
            open_, last = int(text[-1]), w.hashes[-1:]


@dataclass
class Model:
    """weights: of each bucket, the share in the difference of the two classes' logits."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        n = len(texts)
        total, many = np.zeros(n), np.zeros(n)
        for places, at, inverse, text, again in _bags(texts):
            each = np.add.reduceat(self.weights[places], at[:-1])
            repeats = np.bincount(again, minlength=n)
            total += np.bincount(text, each[inverse], n) + repeats * self.weights[BUCKETS]
            many += np.bincount(text, np.diff(at)[inverse], n) + repeats
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(many, 1), -30, 30)))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and the share of each in its mean."""
    every, times = [np.zeros(0, np.int64)], [np.zeros(0)]
    for places, at, inverse, _, again in _bags([text]):
        each = np.bincount(inverse, minlength=len(at) - 1)
        every += [places, np.full(min(1, len(again)), BUCKETS)]
        times += [np.repeat(each, np.diff(at)), np.full(min(1, len(again)), len(again))]
    place, index = np.unique(np.concatenate(every), return_inverse=True)
    share = np.bincount(index, np.concatenate(times), len(place))
    return place, (share / max(1.0, share.sum())).astype(np.float32)


def train(rows: list[tuple[str, int]], counts: dict[int, int], seed: int = 7) -> Model:
    have = [sum(1 for _, y in rows if y == c) for c in (0, 1)]
    if not all(have):
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0)
    weight = np.array([counts[c] / have[c] for c in (0, 1)])
    weight /= (weight * have).sum() / len(rows)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    known = [(*features(t.encode()), y) for t, y in rows]
    steps, step = EPOCHS * len(known), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(known)):
            place, share, y = known[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[place]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            # few examples of a class weigh more; one step stays bounded
            p *= min(3.0, weight[y])
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            vectors[place] -= (rate * len(place) ** 0.5) * share[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """``doc_id`` and the model's score of the whole text of every row; model has scores(list of UTF-8 texts)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(first, len(texts)), name: pa.array(sent.value.scores(texts), pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {kind}, {name} double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; labels of held-out documents are not learned from."""
    out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    rows, counts = sample(docs, labels, "quality", ~out, MOST)
    fitted = train(rows, counts)
    del rows
    trim()
    return score(docs, fitted).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
