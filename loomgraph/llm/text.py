"""Vectorised word hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that go together; a longer text is a block of its own.
CHUNK = 700_000
#: Bytes that are hashed at once.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _accumulated(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n + 1, np.uint64(base), np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _powers(slice_: int) -> tuple[np.ndarray, np.ndarray]:
    return _accumulated(slice_)


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of ranges of values: sums that depend on the values in the range and their order alone.

    That of two ranges one after the other is the first one's plus the base to the power of its length times the second's.
    """
    power, inverse = _powers(SLICE) if len(values) <= SLICE else _accumulated(len(values))
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=h[1:])
    return (h[end] - h[begin]) * inverse[begin]


def hashes(sums_: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(sums_ + lengths.astype(np.uint64))


class Joined:
    """Ranges of bytes found slice by slice: one that goes on in the next slice is one range."""

    def __init__(self) -> None:
        self.begin, self.end, self.sums, self.extra = [], [], [], []

    def add(self, at: int, begin: np.ndarray, end: np.ndarray, raw: np.ndarray, extra: np.ndarray, joins: bool) -> None:
        """Ranges of a slice that begins at ``at``; with joins, the first is the rest of the last one. extra is summed."""
        begin, end = begin + at, end + at
        if joins:
            length = int(self.end[-1][-1] - self.begin[-1][-1])
            more = int(raw[0]) * pow(_BASE, length, 1 << 64) + int(self.sums[-1][-1])
            self.sums[-1][-1] = np.uint64(more & (1 << 64) - 1)
            self.end[-1][-1], self.extra[-1][-1] = end[0], self.extra[-1][-1] + extra[0]
            begin, end, raw, extra = begin[1:], end[1:], raw[1:], extra[1:]
        if len(begin):
            self.begin.append(begin), self.end.append(end), self.sums.append(raw), self.extra.append(extra)

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where ranges begin and end, their hashes, and the sums of extra."""
        if not self.begin:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        begin, end, raw, extra = (np.concatenate(x) if len(x) > 1 else x[0] for x in (self.begin, self.end, self.sums, self.extra))
        return begin, end, hashes(raw, end - begin), extra


@dataclass
class Words:
    """Words of several texts: where each lies in data, its hash, and where each text's words begin (one more than texts)."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(texts: list[bytes], inside: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes b with inside[b]; hashes are of A-Z as lower case if asked for, data is as given.

    Work goes in slices of SLICE bytes, so that a long text takes little more than itself and its words.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    found, open_ = Joined(), False
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        ok = inside[part]
        ok[edges[np.searchsorted(edges, at) : np.searchsorted(edges, at + len(part))] - at] = False
        change = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).view(np.int8)))
        begin, end = change[::2], change[1::2]
        raw = sums((lowered(part) if lower else part).astype(np.uint64) + np.uint64(1), begin, end)
        found.add(at, begin, end, raw, np.zeros(len(begin), np.int8), open_ and bool(ok[0]))
        open_ = bool(ok[-1])
    begin, end, hashed, _ = found.ranges()
    return Words(data, begin, end, hashed, np.searchsorted(begin, np.concatenate([[0], edges + 1])))


def table(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: Everything but the blank and the control characters 9 to 13.
NOT_SPACE = table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: ASCII letters and digits, and all bytes of other characters.
LETTERS = table(lambda b: b >= 0x80 or chr(b).isalnum())

_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, 17)]


def _rolled(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size neighbours."""
    full = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        full += hashed[k : k + len(full)] * _STEP[k]
    return mix(full)


def shingles(texts: list[bytes], size: int, inside: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than size, the whole sequence is the one shingle."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    open_, tail, before = -1, np.zeros(0, np.uint64), 0
    for owners, block in parted(texts, inside):
        w = words(block, inside)
        full = _rolled(w.hashes, size)
        for i, a, b in zip(owners, w.starts[:-1].tolist(), w.starts[1:].tolist()):
            if i == open_:
                # a text that goes on: shingles across the cut take the last words of the part before
                own = np.concatenate([tail, w.hashes[a:b]])
                rolled = _rolled(own, size)
            else:
                before, own, rolled = 0, w.hashes[a:b], full[a : max(a, b - size + 1)]
            total = before + b - a
            if 0 < total < size:
                out[i] = [mix(np.array([sum(int(x) * int(_STEP[k]) for k, x in enumerate(own)) + total & (1 << 64) - 1], np.uint64))]
            elif total:
                out[i] = [*(out[i] if before >= size else []), np.unique(rolled)]
            open_, tail, before = i, own[len(own) - min(len(own), size - 1) :], total
    return [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint64) for x in out]


def parted(texts: list[bytes], inside: np.ndarray, whole: bool = True) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in blocks of some CHUNK bytes, with the index of each; longer ones in parts, cut where no word is.

    A word of more than CHUNK bytes is cut only if it need not stay whole.
    """
    owners: list[int] = []
    block: list[bytes] = []
    room = CHUNK
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not len(text):
            stop = min(len(text), at + CHUNK)
            while stop < len(text) and inside[text[stop - 1]] and inside[text[stop]]:
                # the next byte outside of words
                outside = np.flatnonzero(~inside[np.frombuffer(text, np.uint8, min(CHUNK, len(text) - stop), stop)])
                if not len(outside) and not whole:
                    break
                stop = stop + int(outside[0]) if len(outside) else min(len(text), stop + CHUNK)
            if block and stop - at > room:
                yield owners, block
                owners, block, room = [], [], CHUNK
            owners.append(i), block.append(text[at:stop])
            room -= stop - at
            at = stop
            if not len(text):
                break
    if block:
        yield owners, block


def blocks(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in blocks of about CHUNK bytes, with the index of each block's first."""
    i = 0
    while i < len(values):
        j, room = i, CHUNK
        while j < len(values) and (j == i or len(values[j]) <= room):
            room -= len(values[j])
            j += 1
        yield i, values[i:j]
        i = j


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts as UTF-8, null as empty, in blocks."""
    return blocks(pc.fill_null(column.cast(pa.string()), "").cast(pa.binary()).to_pylist())
