"""A toxicity classifier with a counterfactual penalty.

A document is the set of its words and of some of their character n-grams. A sparse logistic model of words alone
chooses those that tell the classes apart; a second model weighs them together with the n-grams of those that speak for
toxicity, so that an unseen inflection of an insult still counts. N-grams also reach words that are no insults, among
them those that name groups of people. So each labelled text gives counterfactuals: a term of ``IDENTITY`` that it names
is swapped for others of its kind; where it names none, a term is put into it, in one of four languages by turns, and
then swapped, and if the text is not toxic it is also compared with itself without the term. The squared change of the
logit is added to the loss of both models, so that to name a group, or one group rather than another, does not move a score. Both are
fitted by accelerated proximal gradient steps in numpy.

A model is a table of features with weights: words that it does not know weigh nothing, however long a text is.
Training takes at most ``MOST`` labelled texts of each class, weighted so that classes count as they do among all
labels. Labels, lang, source and doc_id are no features.

Defined cases: a null text is an empty one; texts without known words get the score of the bias alone; a text is worked
on in parts, cut between words, and a word of more than ``CHUNK`` bytes is several; repeated rows get equal scores, as a
score depends on the text alone, and 0.5 is predicted as 1; a doc_id with labels that differ is not learned from; without
labels of both classes every score is some 1e-13 and nothing is toxic; an empty table gives no rows; columns other than
doc_id and text are not read, and :func:`accepted` passes all through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim
from .labelled import remainder, sample
from .quality import score
from .text import LETTERS, lowered, parted, words

#: Labelled texts of each class that a model is fitted on at most.
MOST = 3000
#: Texts that a word must occur in to be weighed.
LEAST = 5
#: Strength of the absolute penalty in the first and second fit, of the squared one in the second, and of the counterfactual one.
SPARSE, AGAIN, RIDGE, FAIR = 4e-4, 1e-4, 1e-5, 1.0
#: Steps of each fit at most.
ROUNDS = 250
#: Swaps made of one text.
SWAPS = 3
#: Terms that name groups of people, by language and kind. Terms of a kind are swapped for one another.
IDENTITY = [
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["women", "men", "girls", "boys", "immigrants", "refugees", "foreigners", "teenagers", "pensioners"],
    ["woman", "man", "girl", "boy", "immigrant", "refugee", "foreigner", "teenager", "pensioner"],
    ["gay", "lesbian", "bisexual", "transgender", "straight", "queer", "disabled", "deaf", "blind"],
    ["black", "white", "asian", "african", "european", "american", "mexican", "chinese", "indian", "arab"],
    ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"],
    ["frauen", "männer", "mädchen", "jungen", "ausländer", "flüchtlinge", "behinderte", "rentner"],
    ["schwule", "lesben", "schwarze", "weiße", "afrikaner", "araber", "türken", "polen"],
    ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"],
    ["femmes", "hommes", "filles", "garçons", "étrangers", "réfugiés", "handicapés", "retraités"],
    ["homosexuels", "lesbiennes", "noirs", "blancs", "africains", "arabes", "maghrébins", "roms"],
    ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"],
    ["mujeres", "hombres", "niñas", "niños", "extranjeros", "refugiados", "discapacitados", "jubilados"],
    ["homosexuales", "lesbianas", "negros", "blancos", "africanos", "árabes", "gitanos", "latinos"],
]


def _grams(data: np.ndarray) -> np.ndarray:
    """The four bytes from each place on, lower-cased and with blanks between words, as one number; 0 where no word is within."""
    plain = np.where(LETTERS[data], lowered(data), 32).astype(np.uint32)
    code = plain[:-3] | plain[1:-2] << np.uint32(8) | plain[2:-1] << np.uint32(16) | plain[3:] << np.uint32(24)
    code[(plain[1:-2] == 32) | (plain[2:-1] == 32)] = 0
    return code


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(12)


class Features:
    """The place of each known word, by its hash, and of each known n-gram in a table of features."""

    def __init__(self, known_words: np.ndarray, known_grams: np.ndarray):
        self.words, self.grams = np.unique(known_words), np.unique(known_grams)
        self.size = len(self.words) + len(self.grams)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[_bits(self.grams)] = True

    def _at(self, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return at, table[at] == values

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature of each known feature of each text, once each, sorted."""
        pairs = [np.zeros(0, np.int64)]
        for owners, block in parted(texts, LETTERS, whole=False):
            owner = np.array(owners)
            w = words(block, LETTERS)
            if len(self.words):
                at, known = self._at(self.words, w.hashes)
                pairs.append(np.unique(np.repeat(owner, np.diff(w.starts))[known] * self.size + at[known]))
            if len(self.grams):
                code = _grams(np.concatenate([[np.uint8(32)], w.data, np.full(2, 32, np.uint8)]))
                hit = np.flatnonzero(self.maybe[_bits(code)])
                at, known = self._at(self.grams, code[hit])
                ends = np.cumsum([len(b) + 1 for b in block])
                pairs.append(np.unique(owner[np.searchsorted(ends, hit[known], "right")] * self.size + len(self.words) + at[known]))
        every = np.unique(np.concatenate(pairs))
        return (every // self.size, every % self.size) if self.size else (every, every)


@dataclass
class Model:
    """Features and the weight of each; pairs is the number of counterfactuals of its fit."""

    features: Features
    weights: np.ndarray
    bias: float
    pairs: int = 0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        text, feature = self.features.of(texts)
        return self.bias + np.bincount(text, self.weights[feature], len(texts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def _vocabulary(texts: list[bytes]) -> np.ndarray:
    """The hashes of words that at least LEAST texts have."""
    seen: list[np.ndarray] = []
    for _, block in parted(texts, LETTERS, whole=False):
        w = words(block, LETTERS)
        seen += [np.unique(w.hashes[a:b]) for a, b in zip(w.starts[:-1], w.starts[1:])]
    found, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0))
    return found[times >= LEAST]


def _spelled(texts: list[bytes], wanted: np.ndarray) -> list[bytes]:
    """The words of these hashes, as texts spell them first."""
    out: dict[int, bytes] = {}
    left = set(wanted.tolist())
    for _, block in parted(texts, LETTERS, whole=False):
        if not left:
            break
        w = words(block, LETTERS)
        for i in np.flatnonzero(np.isin(w.hashes, np.array(sorted(left), np.uint64))):
            if (h := int(w.hashes[i])) in left:
                out[h] = w.data[w.begin[i] : w.end[i]].tobytes()
                left.remove(h)
    return [out[h] for h in sorted(out)]


def counterfactuals(texts: list[bytes], labels: list[int], swaps: int = SWAPS) -> Iterator[tuple[bytes, bytes, bytes]]:
    """A text without the term, the term, and what comes in its place (b"": nothing).

    Texts that name a term, in order of kinds, give swaps of it; others, by turns, swaps of a term put into them.
    """
    kinds = [[t.encode() for t in kind] for kind in IDENTITY]
    known = {t: kind for kind in reversed(kinds) for t in kind}
    # longer words first, as a word must match whole
    word = re.compile(rb"(?<![a-z0-9\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, known), key=len, reverse=True)) + rb")(?![a-z0-9\x80-\xff])", re.IGNORECASE)
    for i, (text, label) in enumerate(zip(texts, labels)):
        named = word.search(text)
        if named:
            term = named[0].lower()
            base = re.sub(rb"(?<![a-z0-9\x80-\xff])" + re.escape(term) + rb"(?![a-z0-9\x80-\xff])", b"", text, flags=re.IGNORECASE)
            kind = known.get(term, [])
        else:
            kind, base = kinds[i % len(kinds)], text
            term = kind[i // len(kinds) % len(kind)]
        others = [t for t in kind if t != term]
        first = i % max(1, len(others))
        for other in (others[first:] + others[:first])[:swaps]:
            yield base, term, other
        if label == 0:
            yield base, term, b""


def train(rows: list[tuple[str, int]], counts: dict[int, int], fair: float = FAIR) -> Model:
    have = [sum(1 for _, y in rows if y == c) for c in (0, 1)]
    if not all(have):
        return Model(Features(np.zeros(0, np.uint64), np.zeros(0, np.uint32)), np.zeros(0), -30.0)
    texts, labels = [t.encode() for t, _ in rows], [c for _, c in rows]
    y = np.array(labels, float)
    share = np.array([counts[c] / have[c] for c in (0, 1)])[labels]
    share /= share.sum()
    start = float(np.log(counts[1] / counts[0]))
    terms = words(sorted({t.encode() for kind in IDENTITY for t in kind}), LETTERS).hashes
    # the absolute penalty chooses words but also shrinks them; the chosen ones are fitted again with less of it
    every = Features(np.concatenate([_vocabulary(texts), terms]), np.zeros(0, np.uint32))
    w, b = _fit(every.of(texts), y, share, _differences(every, texts, labels)[0], fair, np.zeros(every.size), start, SPARSE, 0.0)
    bad = _spelled(texts, every.words[w > 0])
    grams = [np.unique(_grams(np.frombuffer(b" " + x + b"  ", np.uint8))) for x in bad]
    known = Features(np.concatenate([every.words[w != 0], terms]), np.concatenate([np.zeros(0, np.uint32), *grams]))
    first = np.zeros(known.size)
    first[np.searchsorted(known.words, every.words[w != 0])] = w[w != 0]
    swap, pairs = _differences(known, texts, labels)
    w, b = _fit(known.of(texts), y, share, swap, fair, first, b, AGAIN, RIDGE)
    return Model(known, w, float(b), pairs)


def _differences(known: Features, texts: list[bytes], labels: list[int]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Sparse rows of the features that counterfactuals lose (1) and win (-1), and how many counterfactuals there are."""
    made = list(counterfactuals(texts, labels))
    bases = list(dict.fromkeys(base for base, _, _ in made))
    number = {base: i for i, base in enumerate(bases)}
    text, feature = known.of(bases)
    at = np.searchsorted(text, np.arange(len(bases) + 1))
    has = [set(feature[x:z].tolist()) for x, z in zip(at, at[1:])]
    terms = sorted({t for _, *both in made for t in both})
    text, feature = known.of(terms)
    adds = {t: set(feature[text == i].tolist()) for i, t in enumerate(terms)}
    row, column, value = [], [], []
    for n, (base, term, other) in enumerate(made):
        own = has[number[base]]
        goes, comes = adds[term] - own, adds[other] - own
        for f in sorted(goes ^ comes):
            row.append(n), column.append(f), value.append(1.0 if f in goes else -1.0)
    return (np.array(row, np.int64), np.array(column, np.int64), np.array(value)), len(made)


def _fit(entries, y: np.ndarray, share: np.ndarray, swap, fair: float, w: np.ndarray, b: float, sparse: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias after accelerated proximal gradient steps; entries and swap are sparse rows."""
    (row, column), (crow, ccol, cval) = entries, swap
    n, m, k = len(y), len(w), int(crow.max()) + 1 if len(crow) else 1

    def smooth(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = np.bincount(row, w[column], n) + b
        loss = share @ np.logaddexp(0, np.where(y > 0, -z, z)) + ridge * (w @ w)
        r = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(column, r[row], m) + 2 * ridge * w
        if len(crow):
            d = np.bincount(crow, cval * w[ccol], k)
            loss += fair * (d @ d) / k
            g += 2 * fair / k * np.bincount(ccol, cval * d[crow], m)
        return loss, g, float(r.sum())

    u, c, momentum, step = w, b, 1.0, 1.0
    for _ in range(ROUNDS):
        loss, g, gb = smooth(u, c)
        while True:
            x = u - step * g
            new, nb = np.sign(x) * np.maximum(np.abs(x) - step * sparse, 0), c - step * gb
            dw, db = new - u, nb - c
            if smooth(new, nb)[0] <= loss + g @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        u, c = new + (momentum - 1) / after * (new - w), nb + (momentum - 1) / after * (nb - b)
        still = np.abs(new - w).max(initial=0.0) < 1e-4 and abs(nb - b) < 1e-4
        w, b, momentum, step = new, nb, after, step * 1.1
        if still:
            break
    return w, b


def model(docs: DataFrame, labels: DataFrame) -> Model:
    """A model fitted on the labels of rows that are not held out."""
    fitted = train(*sample(docs, labels, "toxic", ~held_out(), MOST))
    trim()
    return fitted


def held_out():
    return F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; labels of held-out documents are not learned from."""
    scored = score(docs, model(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, each once for as often as it occurs."""
    from pyspark.sql import types as T

    from .common import lean, ship

    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        from .text import chunks

        for batch in batches:
            for first, texts in chunks(batch.column(at)):
                yield batch.slice(first, len(texts)).filter(pa.array(sent.value.scores(texts) < 0.5))

    return docs.mapInArrow(lean(run), T.StructType(docs.schema.fields))
