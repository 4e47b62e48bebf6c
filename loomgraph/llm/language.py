"""Languages of documents as a mixture, by expectation-maximisation over words.

A model has, for each language that some documents are labelled with, the frequencies of hashed n-grams of words, counted
over all those documents. A word's likelihood in a language is that of its n-grams, averaged over the sizes. A document
is a bag of words, each drawn from one of its languages: expectation-maximisation estimates the languages' proportions.
Of the nested sets of the most frequent languages, that of the highest likelihood less a penalty for each further language
is selected, and its proportions are estimated again.

A document's language is the selected one of the largest proportion; its score is that proportion times the probability
that the whole text, were it all in one language, is in this one.

Defined cases: a null text, one without a letter, and any text where nothing was learned is ``und`` with score 0 and no
languages; letters without a known n-gram are of the most frequent language; texts are lower-cased and worked on in parts
cut between words, and a word of more than ``CHUNK`` bytes counts as several; of languages of equal proportion the one
with more documents comes first, then the smaller name; repeated rows count and are judged each for itself; rows with a
null lang or text are not learned from; beyond ``MOST_LANGUAGES`` the languages with the fewest documents are no part of the
model; an empty table gives no rows; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, ship
from .labelled import remainder
from .text import Words, chunks, hashes, parted, sums, table, words

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
#: Languages of a model at most (BUCKETS numbers each).
MOST_LANGUAGES = 100
#: Languages of a document that expectation-maximisation considers: those with the largest shares after its first step.
CANDIDATES = 8
ROUNDS = 12
#: What a further language costs, in logarithms of the number of words.
PENALTY = 3.0
#: Weight of the even distribution in each language's frequencies.
EVEN = 1e-3
#: Languages whose counts a task holds at once.
HELD = 32
UNKNOWN = "und"

#: ASCII letters and all bytes of other characters.
_INSIDE = table(lambda b: b >= 0x80 or chr(b).isalpha())
_LETTER = regex.compile(r"\p{L}")


def _lowered(text: bytes) -> bytes:
    return text.decode().lower().encode()


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words: buckets of their n-grams, where each word's begin (one more than words); and each place's word."""
    _, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    size = w.end[at] - w.begin[at] + 2
    stop = np.cumsum(size)
    start = stop - size
    # every word between two marks
    data = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint64)
    inner = np.ones(len(data), bool)
    inner[start], inner[stop - 1] = False, False
    data[inner] = w.data[(np.repeat(w.begin[at] - start - 1, size) + np.arange(len(data)))[inner]]
    data += np.uint64(1)
    found, owner = [], []
    word = np.arange(len(at))
    for n in GRAMS:
        many = np.maximum(size - n + 1, 0)
        begin = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        found.append((hashes(sums(data, begin, begin + n), np.full(len(begin), n)) >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owner.append(np.repeat(word, many))
    by = np.concatenate(owner)
    order = np.argsort(by, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(by[order], np.arange(len(at) + 1)), inverse


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows (lang, text); bucket -1 counts the rows. Every task adds up its own texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at - 1, pa.int32()), "n": pa.array(n[at], pa.int64())})
            total.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in chunks(batch.column(1)):
                known, whose = np.unique(langs[first : first + len(texts)], return_inverse=True)
                for lang, n in zip(known.tolist(), np.bincount(whose).tolist()):
                    if lang not in total and len(total) >= HELD:
                        yield from handed()
                    total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[0] += n
                for owners, block in parted([_lowered(t) for t in texts], _INSIDE, whole=False):
                    w = words(block, _INSIDE, lower=False)
                    if not len(w.hashes):
                        continue
                    found, at, inverse = grams(w)
                    owner = np.repeat(whose[owners], np.diff(w.starts))
                    for i, lang in enumerate(known.tolist()):
                        times = np.bincount(inverse[owner == i], minlength=len(at) - 1)
                        if times.any():
                            if lang not in total and len(total) >= HELD:
                                yield from handed()
                            more = np.bincount(found, np.repeat(times, np.diff(at)), BUCKETS)
                            total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[1:] += more.astype(np.int64)
        yield from handed()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(lean(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """names: languages, the most frequent first. logs: of each bucket and language, the logarithm of its frequency."""

    names: list[str]
    logs: np.ndarray

    def mixtures(self, texts: list[bytes]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Of each text: the probability of its first language, and languages and proportions of its mixture, the largest first."""
        owner, times, logs = self._bags(texts)
        single = np.zeros((len(texts), len(self.names)))
        np.add.at(single, owner, times[:, None] * logs)
        # of equal likelihoods, the first name counts
        top = single.argmax(1)
        likely = 1 / np.exp(np.maximum(single - single.max(1, keepdims=True), -700)).sum(1)
        out = [(float(p), [(int(t), 1.0)]) for p, t in zip(likely, top)]
        held = np.bincount(owner, minlength=len(texts)) > 0
        if not held.any() or len(self.names) == 1:
            return out
        # texts with words, numbered anew; owner is sorted
        rows, who = np.flatnonzero(held), np.cumsum(held)[owner] - 1
        for row, p, found in zip(rows.tolist(), *_mixed(who, times, logs, single[rows])):
            out[row] = (float(np.exp(single[row, found[0][0]] - single[row].max()) * likely[row]), found) if p else out[row]
        return out

    def _bags(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of each text: the text, how many times, and the word's log likelihood in each language."""
        owner, times, logs = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros((0, len(self.names)))]
        for owners, block in parted([_lowered(t) for t in texts], _INSIDE, whole=False):
            w = words(block, _INSIDE, lower=False)
            if len(w.hashes):
                found, at, inverse = grams(w)
                each = np.add.reduceat(self.logs[found], at[:-1]) / len(GRAMS)
                key, n = np.unique(np.repeat(np.array(owners), np.diff(w.starts)) * len(each) + inverse, return_counts=True)
                owner.append(key // len(each)), times.append(n), logs.append(each[key % len(each)])
        return np.concatenate(owner), np.concatenate(times).astype(float), np.concatenate(logs)


def _rounds(share: np.ndarray, who: np.ndarray, first: np.ndarray, times: np.ndarray, odds: np.ndarray, total: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds from ``share``, and the log likelihood of each text under the last but one."""
    for _ in range(rounds):
        part = odds * share[who]
        whole = part.sum(1)
        share = np.add.reduceat(part * (times / whole)[:, None], first) / total[:, None]
    return share, np.add.reduceat(times * np.log((odds * share[who]).sum(1)), first)


def _mixed(who: np.ndarray, times: np.ndarray, logs: np.ndarray, single: np.ndarray) -> tuple[list[bool], list[list[tuple[int, float]]]]:
    """Of each text, whether a mixture of several languages is selected, and its languages and proportions."""
    n, many = single.shape
    first = np.searchsorted(who, np.arange(n))
    total = np.add.reduceat(times, first)
    high = logs.max(1, keepdims=True)
    odds = np.exp(np.maximum(logs - high, -60))
    # relative to each word's best language, as are all likelihoods that follow
    base = np.add.reduceat(times * high[:, 0], first)
    tongues = np.tile(np.arange(many), (n, 1))
    if many > CANDIDATES:
        share, _ = _rounds(np.full((n, many), 1 / many), who, first, times, odds, total, 1)
        tongues = np.sort(np.argsort(-share, 1, kind="stable")[:, :CANDIDATES], 1)
        odds = np.take_along_axis(odds, tongues[who], 1)
    share, _ = _rounds(np.full(tongues.shape, 1 / tongues.shape[1]), who, first, times, odds, total, ROUNDS)
    order = np.argsort(-share, 1, kind="stable")
    best = single.max(1) - base
    several, chosen = np.zeros(n, bool), [[] for _ in range(n)]
    open_ = np.ones(n, bool)
    for size in range(2, tongues.shape[1] + 1):
        # only texts that the last language has helped go on
        mine = open_[who]
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        own = (np.cumsum(open_) - 1)[who[mine]]
        start = np.searchsorted(own, np.arange(len(rows)))
        pick = order[rows, :size]
        some = np.take_along_axis(odds[mine], pick[own], 1)
        begin = np.take_along_axis(share[rows], pick, 1) + 1e-9
        got, likelihood = _rounds(begin / begin.sum(1, keepdims=True), own, start, times[mine], some, total[rows], ROUNDS // 2)
        helped = likelihood - PENALTY * (size - 1) * np.log(total[rows] + 1) > best[rows]
        for row, ok, p, g, value in zip(rows.tolist(), helped.tolist(), pick, got, likelihood - PENALTY * (size - 1) * np.log(total[rows] + 1)):
            if ok:
                by = sorted(zip(tongues[row, p].tolist(), g.tolist()), key=lambda x: (-x[1], x[0]))
                several[row], chosen[row], best[row] = True, by, value
            else:
                open_[row] = False
    return several.tolist(), chosen


def learned(docs: DataFrame) -> Model | None:
    """The model of the languages of ``docs`` (lang, text); None where there are none. At most MOST_LANGUAGES * BUCKETS sums reach the driver."""
    counts = gram_counts(docs).persist()
    try:
        names = [r["lang"] for r in counts.where("bucket = -1").orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
        if not names:
            return None
        rows = counts.where(F.col("lang").isin(names) & (F.col("bucket") >= 0)).toArrow()
    finally:
        counts.unpersist()
    n = np.zeros((BUCKETS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    n[rows["bucket"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    return Model(names, np.log((1 - EVEN) * n / np.maximum(1, n.sum(0)) + EVEN / BUCKETS).astype(np.float32))


def languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` of every row; languages are structs of lang and share, the largest share first."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<struct<lang:string,share:double>>").alias("languages"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    listed = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.names
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                out: list[tuple[str, float, list]] = []
                for text, (p, found) in zip(texts, sent.value.mixtures(texts)):
                    if _LETTER.search(text.decode()):
                        out.append((names[found[0][0]], min(1.0, p * found[0][1]), [{"lang": names[i], "share": s} for i, s in found]))
                    else:
                        out.append((UNKNOWN, 0.0, []))
                lang, score, mixture = zip(*out)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(first, len(texts)), "lang_pred": pa.array(lang), "score": pa.array(score), "languages": pa.array(mixture, listed)})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def rendered(found: Column) -> Column:
    """``de=0.71 en=0.29``."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["lang"], F.lit("="), F.format_number(x["share"], 2))), " ")


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages``: the languages of held-out documents are not learned from."""
    out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    found = languages(docs, learned(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", rendered(F.col("languages")).alias("languages"))
