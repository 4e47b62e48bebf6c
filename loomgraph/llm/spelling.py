"""Grouping of spelling variants: words that differ by one code point, found in tries by Levenshtein automata.

Words and their counts come from one pass over the texts and one aggregation. The vocabulary, sorted by range, is cut into
tries of at most ``LETTERS`` letters: flat arrays of labels, first children and counts, a row of a table each. Tries are
broadcast, at most ``SENT`` bytes of them at a time, and each word's distance-one automaton runs over every trie
depth-first, from a stack of states (word, node, letters read, edited or not), many words' states side by side. A state
that has not edited yet follows the word, skips one of its letters, or takes any child for a letter more or another
letter; one that has follows the word alone, and accepts at a word's end. A word's neighbours in all tries are reduced to
their number and the best of them.

Forms point to words of at least twice the count, so that there are no rings; roots come from pointer jumping, in some
log log rounds, each a written table.

Defined cases: a null text is an empty one; a null doc_id is hashed as an empty string; runs of fewer letters than
``least`` are no words and cost nothing; a run of any length is one word, and a trie of its own beyond ``LETTERS``, walked
in as many steps as it has letters (some 0.1 ms each);
repeated rows count each for itself; ties between forms go to the smallest in code-point order; a word without a near one,
or with none frequent enough, has no form and is its own root; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, parts, ship, written
from .text import blocks

#: Letters of a trie at most, if it is not one long word.
LETTERS = 1 << 20
#: Bytes of tries that are broadcast at once; further ones go in further passes.
SENT = 24 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Words whose automata run side by side.
ABREAST = 4096
#: States of a frame of the stack; larger frames are cut.
FRAME = 1 << 18
#: Words of a task at least.
ROWS = 20_000
#: Letters of a text whose words are listed at once.
SLICE = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_OUTSIDE = re.compile(rb"[^a-z\xc0-\xff]")


def runs(text: str, least: int) -> Iterator[list[bytes]]:
    """The maximal runs of at least ``least`` letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, as Latin-1, slice by slice.

    All other characters beyond Latin-1 become a question mark, which is no letter.
    """
    data = text.encode("latin-1", "replace").translate(_LOWER)
    word, at = re.compile(rb"[a-z\xc0-\xff]{%d,}" % max(1, least)), 0
    while at < len(data):
        cut = _OUTSIDE.search(data, at + SLICE)
        stop = cut.start() if cut else len(data)
        yield word.findall(data, at, stop)
        at = stop


def word_counts(docs: DataFrame, least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """``word, n`` of all words of at least ``least`` code points and ``times`` occurrences.

    Where ``every`` divides the CRC-32 of ``doc_id:run``, the run loses the code point at that number modulo its length.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            words = list(total)
            for i, some in blocks(words):
                yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in some], pa.string()), "n": pa.array([total[w] for w in some], pa.int64())})
            total.clear()

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                state = zlib.crc32(f"{key.as_py()}:".encode())
                own: Counter = Counter()
                for found in runs(text.as_py(), least):
                    own.update(found)
                for word, n in own.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), state)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) >= HELD:
                    yield from handed()
        yield from handed()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return keyed.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


@dataclass
class Trie:
    """Nodes are numbered level by level, so that a node's children follow one another, and child i of all is node i + 1.

    keys: of each child, its parent times 256 plus its letter, which is sorted. first: where each node's children begin
    (one more than nodes). some: a bit for each child's letter modulo 64. place: of each node the rank of the word that
    ends there, -1 where none does. counts: the occurrences of the words in order of rank, which is that of their bytes.
    ends: the node of each rank.
    """

    keys: np.ndarray
    first: np.ndarray
    some: np.ndarray
    place: np.ndarray
    counts: np.ndarray
    ends: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {"letters": (self.keys & 255).astype(np.uint8).tobytes(), "first": self.first.tobytes(), "ends": self.ends.tobytes(), "counts": self.counts.tobytes()}

    @staticmethod
    def unpacked(letters: bytes, first: bytes, ends: bytes, counts: bytes) -> Trie:
        letter, start, end = np.frombuffer(letters, np.uint8), np.frombuffer(first, np.int32), np.frombuffer(ends, np.int32)
        many = np.diff(start)
        some = np.zeros(len(many), np.uint64)
        if len(letter):
            some[many > 0] = np.bitwise_or.reduceat(np.uint64(1) << (letter & 63).astype(np.uint64), start[:-1][many > 0])
        place = np.full(len(many), -1, np.int32)
        place[end] = np.arange(len(end))
        return Trie(np.repeat(np.arange(len(many)), many) * 256 + letter, start, some, place, np.frombuffer(counts, np.int64), end)

    def word(self, rank: int) -> bytes:
        """The word of a rank, read upwards."""
        node, out = int(self.ends[rank]), bytearray()
        while node:
            key = int(self.keys[node - 1])
            out.append(key & 255)
            node = key >> 8
        return bytes(out[::-1])


def built(words: list[bytes], counts: list[int]) -> Trie:
    """The trie of distinct words in byte order."""
    parent, letter, depth, ends = [], [], [], []
    path, last = [0], b""
    for word in words:
        same = 0
        for a, b in zip(word, last):
            if a != b:
                break
            same += 1
        del path[same + 1 :]
        for at in range(same, len(word)):
            parent.append(path[-1]), letter.append(word[at]), depth.append(at + 1)
            path.append(len(parent))
        ends.append(path[-1])
        last = word
    # from the order of a walk to that of levels
    order = np.argsort(np.array(depth, np.int64), kind="stable")
    number = np.zeros(len(parent) + 1, np.int64)
    number[order + 1] = np.arange(1, len(parent) + 1)
    up, letters = number[np.array(parent, np.int64)[order]], np.array(letter, np.uint8)[order]
    first = np.searchsorted(up, np.arange(len(parent) + 2))
    return Trie.unpacked(letters.tobytes(), first.astype(np.int32).tobytes(), number[np.array(ends, np.int64)].astype(np.int32).tobytes(), np.array(counts, np.int64).tobytes())


def tries(vocabulary: DataFrame) -> DataFrame:
    """``name, size, letters, first, ends, counts``: the tries of ``word, n``, a written table of a row each."""
    spark = vocabulary.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        counts: list[int] = []
        used, made_so_far, task = 0, 0, TaskContext.get().partitionId()

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal made_so_far
            got = built(words, counts).packed()
            made_so_far += 1
            head = {"name": pa.array([f"{task}-{made_so_far}"]), "size": pa.array([sum(map(len, got.values()))], pa.int64())}
            yield pa.RecordBatch.from_pydict(head | {k: pa.array([v], pa.binary()) for k, v in got.items()})

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words and used + len(word) > LETTERS:
                    yield from made()
                    words, counts, used = [], [], 0
                words.append(word.encode("latin-1")), counts.append(n)
                used += len(word)
        if words:
            yield from made()

    # words in UTF-8 sort as their code points do, and so as in Latin-1
    dealt = vocabulary.select("word", "n").repartitionByRange(_many(vocabulary), "word").sortWithinPartitions("word")
    return written(dealt.mapInArrow(lean(run), "name string, size long, letters binary, first binary, ends binary, counts binary"), "tries")


def _many(vocabulary: DataFrame) -> int:
    return max(1, int(vocabulary.agg(F.sum(F.length("word"))).first()[0] or 0) // LETTERS)


def near(trie: Trie, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a word (its index) and a word of the trie (its rank) at a distance of exactly one."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - (size + 1)
    # a letter that no word has ends each of them
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    bit = np.uint64(1) << (data & 63).astype(np.uint64)
    keys, first, some, place = trie.keys, trie.first, trie.some, trie.place
    found_word, found_node = [], []

    def stepped(word: np.ndarray, node: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states that go on by the word's own letter."""
        here = begin[word] + at
        may = (some[node] & bit[here]) != 0
        word, node, at, here = word[may], node[may], at[may], here[may]
        key = node * 256 + data[here]
        child = np.searchsorted(keys, key)
        hit = keys[np.minimum(child, len(keys) - 1)] == key
        return word[hit], child[hit] + 1, at[hit] + 1

    everyone = np.arange(len(words))
    zero = np.zeros(len(words), np.int64)
    stack = [(False, everyone, zero, zero)] if len(keys) else []
    while stack:
        edited, word, node, at = stack.pop()
        if len(word) > FRAME:
            half = len(word) // 2
            stack += [(edited, word[half:], node[half:], at[half:]), (edited, word[:half], node[:half], at[:half])]
            continue
        if edited:
            done = (at == size[word]) & (place[node] >= 0)
            found_word.append(word[done]), found_node.append(node[done])
        on = stepped(word, node, at)
        if len(on[0]):
            stack.append((edited, *on))
        if edited:
            continue
        # of equal letters side by side only the first is skipped, and one more comes after them: other places give the same
        here = begin[word] + at
        left = (at < size[word]) & ((at == 0) | (data[here] != data[here - 1]))
        skipped = (word[left], node[left], at[left] + 1)
        many = (first[node + 1] - first[node]).astype(np.int64)
        owner = np.repeat(np.arange(len(word)), many)
        child = first[node][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        other = (keys[child] & 255) != data[here[owner]]
        owner, child = owner[other], child[other]
        more = (word[owner], child + 1, at[owner])
        inside = at[owner] < size[word[owner]]
        changed = (more[0][inside], more[1][inside], more[2][inside] + 1)
        stack.append((True, *(np.concatenate(x) for x in zip(skipped, more, changed))))
    if not found_word:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # one neighbour can be reached by several edits
    both = np.unique(np.concatenate(found_word) * len(place) + np.concatenate(found_node))
    return both // len(place), place[both % len(place)]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``word, n, n_near, best_n, best`` of all words (word, n): the number of near ones, and of those the one of the largest n, then the smallest."""
    spark = vocabulary.sparkSession
    ship(spark)
    shelf = tries(vocabulary)
    passes: list[list[str]] = [[]]
    used = 0
    for name, size in shelf.select("name", "size").orderBy("name").collect():
        if passes[-1] and used + size > SENT:
            passes.append([])
            used = 0
        passes[-1].append(name)
        used += size
    many = max(parts(spark), vocabulary.count() // ROWS)
    # whatever the order of the vocabulary, each task has words from all over it
    dealt = written(vocabulary.select("word", "n").repartition(many, "word"), "words")
    out = None
    for some in passes:
        packed = [tuple(map(bytes, r)) for r in shelf.where(F.col("name").isin(some)).select("letters", "first", "ends", "counts").collect()]
        sent = spark.sparkContext.broadcast(packed)
        del packed

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, ABREAST):
                    part = batch.slice(first, ABREAST)
                    words = [w.encode("latin-1") for w in part.column(0).to_pylist()]
                    number, best_n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                    best: list[bytes | None] = [None] * len(words)
                    for trie in _opened(sent):
                        who, rank = near(trie, words)
                        number += np.bincount(who, minlength=len(words))
                        n = trie.counts[rank]
                        order = np.lexsort((rank, -n, who))
                        top = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
                        for w, r, m in zip(who[top].tolist(), rank[top].tolist(), n[top].tolist()):
                            if m > best_n[w] or m == best_n[w] and trie.word(r) < best[w]:
                                best_n[w], best[w] = m, trie.word(r)
                    named = pa.array([None if b is None else b.decode("latin-1") for b in best], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(number), pa.array(best_n), named], ["word", "n", "n_near", "best_n", "best"])

        got = dealt.mapInArrow(lean(run), "word string, n long, n_near long, best_n long, best string")
        out = got if out is None else out.unionByName(got)
    if len(passes) == 1:
        return out
    # of the largest n the smallest word: the first by the negative of n
    found = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    return out.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), found.alias("f")).select("word", "n", "n_near", F.coalesce(-F.col("f.m"), F.lit(0)).cast("long").alias("best_n"), F.col("f.best").alias("best"))


_OPEN: dict = {}


def _opened(sent) -> list[Trie]:
    """The tries of a broadcast, unpacked once in a worker; those of another are let go."""
    if _OPEN.get("of") is not sent:
        _OPEN.clear()
        _OPEN.update(of=sent, tries=[Trie.unpacked(*p) for p in sent.value])
    return _OPEN["tries"]


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms are followed to the last by pointer jumping. Forms must make no ring."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.where("moved").limit(1).count():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(at)
        at = new
    return at.select("word", "root")


def variants(docs: DataFrame, least: int = 5, times: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the texts: form is its most frequent near word, if ``ratio`` times as frequent at least."""
    vocabulary = written(word_counts(docs, least, times, every), "vocabulary")
    fits = F.col("best_n") >= ratio * F.col("n")
    rows = written(neighbours(vocabulary).select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "near")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
