"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded: lower case, all ASCII but letters and digits as blanks, one blank between words and at
both ends. An item of n characters may differ by ``budget(n)`` edits. It is split into budget + 1 pieces, one of which
must then occur unchanged, so an automaton over all pieces finds every place where the item can be. Hits are not
kept: those of one item that follow one another make one range of starts, over which Myers' bit-parallel distance verifies
the item once, so that a text of many hits takes time in step with its length and no memory besides itself.

Items are read in blocks of bounded size, each of which goes to all tasks; documents are never shuffled. Each block is
one pass over the documents. The distance given is the least over all places in the document; of places that are equally
near, the first one's end counts.

Defined cases: null texts and items are empty; an item without letters or digits matches nothing, and so does one without
an item_id; an item of fewer than ``2 * PIECE`` folded characters has no budget and matches wherever it occurs word for
word, so that an item of one short word matches every document with that word; equal items match each for itself, rows of
one item_id and text once; a document is tried whole, whatever its length, and repeated rows each for itself; without
items nothing matches; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, ship

#: Least length of a piece; the edit budget of an item of n characters is n // PIECE - 1.
PIECE = 12
#: Characters of items in a block: an automaton over them takes some 80 bytes a character in each worker.
BLOCK = 2_000_000
#: Bytes of a text whose words are listed at once.
SLICE = 1 << 18
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def fold(text: str | None) -> str:
    data = (text or "").lower().encode().translate(_FOLD)
    found, at = [], 0
    while at < len(data):
        # words are listed slice by slice, cut at blanks
        cut = data.find(b" ", at + SLICE)
        stop = cut if cut >= 0 else len(data)
        if words := data[at:stop].split():
            found.append(b" ".join(words))
        at = stop
    return f" {b' '.join(found).decode()} " if found else ""


def budget(n: int) -> int:
    return max(0, n // PIECE - 1)


def pieces(item: str) -> list[tuple[int, str]]:
    """Where each of the item's budget + 1 pieces begins, and the piece."""
    many = budget(len(item)) + 1
    cuts = [len(item) * i // many for i in range(many + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(pattern: str, text: str, most: int) -> tuple[int, int]:
    """The least edit distance of pattern to any part of text and where that part ends; (most + 1, -1) if it is over most.

    Myers' algorithm: the column of differences is one pair of integers of as many bits as the pattern has characters.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = (m, 0) if m <= most else (most + 1, -1)
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        across = (((x & up) + up) ^ up) | x
        plus = down | (~(across | up) & full)
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (~(across | plus) & full)
        down = plus & across
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, f) for i, t in items if (f := fold(t))]
        self.budgets = [budget(len(f)) for _, f in self.items]
        self.tree = ahocorasick.Automaton()
        for k, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item):
                self.tree.add_word(piece, [*self.tree.get(piece, []), (k, offset, len(piece))])
        if len(self.tree):
            self.tree.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, begin, end) of each item in the text, at its best place in the folded text."""
        folded = fold(text)
        if not folded or not len(self.tree):
            return []
        # of each item, the range of starts that its last hits leave possible, and the best place so far
        open_: dict[int, tuple[int, int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for end, found in self.tree.iter(folded):
            for k, offset, size in found:
                most = self.budgets[k]
                if best.get(k, (1,))[0] == 0:
                    continue
                start = end + 1 - size - offset
                low, high = open_.get(k, (start, start))
                n = len(self.items[k][1])
                # hits come by their ends, so that starts of later hits lie at most an item's length before those of earlier ones
                if start <= high + n + 2 * most and high - low <= 8 * n and k in open_:
                    open_[k] = (min(low, start), max(high, start))
                    continue
                if k in open_:
                    self._tried(k, low, high, folded, best)
                open_[k] = (start, start)
        for k, (low, high) in open_.items():
            self._tried(k, low, high, folded, best)
        return sorted((self.items[k][0], d, self.budgets[k], max(0, at - len(self.items[k][1])), at) for k, (d, at) in best.items())

    def _tried(self, k: int, low: int, high: int, folded: str, best: dict[int, tuple[int, int]]) -> None:
        """Verify an item once over all of the starts from low to high; of equally near places the first one's end stays."""
        item, most = self.items[k][1], self.budgets[k]
        least = best[k][0] if k in best else most + 1
        if least:
            a = max(0, low - most)
            d, at = distance(item, folded[a : max(0, high) + len(item) + 2 * most], most)
            if d < least:
                best[k] = (d, a + at)


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...]) -> Matcher:
    return Matcher(list(items))


def blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """The test items, distinct, in blocks of about BLOCK characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = total // BLOCK + 1
    for i in range(many):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == i) if many > 1 else items
        yield tuple(sorted((r["item_id"], r["text"]) for r in part.collect() if r["item_id"] is not None))


FOUND = "doc_id long, item_id long, distance int, budget int, begin int, end int"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance, budget, begin, end`` for every item in every row of ``docs``; places in the folded text."""
    ship(docs.sparkSession)
    out = None
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value)
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            names = ["doc_id", "item_id", "distance", "budget", "begin", "end"]
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in matcher.matches(t.as_py())]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), FOUND)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item of ``benchmark`` matches."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), T.StructType(docs.schema.fields))
    return docs
