"""Byte-level BPE encoding and decoding with recursive DuckDB queries per partition.

Text is split into pieces by the tokenizer's pattern. Each distinct piece that is not itself a token becomes
token-position rows; a recursive query joins adjacent pairs with the merge table and contracts each piece's leftmost
pair of minimum rank until no pair is left. An ordered aggregation over token rows joins the vocabulary for decoding.

The query has two forms. That for most pieces appends a piece's rows anew in each round, one contraction a round, which is
fastest for many short pieces. Pieces of more than ``MAX_ROWS`` bytes (no white space, one class of characters throughout)
are encoded in parts of that length, all of them at once, and joined: where the ids on both sides of a joint would not
stand side by side, the ends around it are encoded together, with more of both sides each time. Ends that grow beyond
``MAX_ROWS`` take the second form, which keeps rows in place, keyed by position, and contracts in one round all occurrences
of the pair of minimum rank, from the left, that do not overlap. That is the same as one after the other unless the new
token may itself be part of a pair of still lower rank; for such tokens a round contracts the leftmost alone.

A piece of 1,000,000 random letters takes some 15 s. A text is split in parts of some ``Limits.chunk`` characters, cut
between pieces, so that memory is that of a part, or of a piece.

Defined cases: a null text counts as empty (no ids, empty bytes); repeated rows are encoded each for itself; an empty
table gives no rows; other columns pass through unless they bear the name of an output column, which then replaces them.
Ranks are below 2**31, and every single byte has one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, ship

#: Ids that are decoded at once.
RUN = 200_000
#: Pieces longer than this many bytes keep their rows in place.
MAX_ROWS = 200


class Limits(NamedTuple):
    """What a worker holds at once; the less, the more often pieces are encoded anew."""

    #: Characters of text that are split at once.
    chunk: int = 1_500_000
    #: Distinct pieces that a worker remembers before it starts anew.
    memory: int = 500_000
    #: Pieces to encode in one recursive query.
    block: int = 30_000


#: For workers that serve other operators as well.
SMALL = Limits(500_000, 150_000, 8_000)

_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = 0, 1, 2, 3, 4

ENCODE_SQL = """
WITH RECURSIVE step(i, w, p, t, nt, k) AS (
  SELECT 0, x.w, x.p, x.t, x.nt, m.n::BIGINT * 4294967296 + x.p
  FROM (SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt FROM pieces) x
  LEFT JOIN merges m ON m.pair = x.t::BIGINT * 4294967296 + x.nt
  UNION ALL
  SELECT y.i + 1, y.w, y.p, y.t, y.nt, CASE WHEN y.changed THEN m.n::BIGINT * 4294967296 + y.p ELSE y.k END
  FROM (
    SELECT s.i, s.w, s.p, s.k, s.p = b.at OR s.p = b.before AS changed,
      CASE WHEN s.p = b.at THEN b.made ELSE s.t END AS t,
      CASE WHEN s.p = b.at THEN b.beyond WHEN s.p = b.before THEN b.made ELSE s.nt END AS nt
    FROM step s JOIN (
      SELECT a.w, (a.mk & 4294967295)::INT AS at, (a.mk >> 32)::INT AS made,
        max(s.p) FILTER (s.p < (a.mk & 4294967295)) AS before, min(s.p) FILTER (s.p > (a.mk & 4294967295)) AS gone,
        arg_min(s.nt, s.p) FILTER (s.p > (a.mk & 4294967295)) AS beyond
      FROM step s JOIN (SELECT w, min(k) AS mk FROM step WHERE k IS NOT NULL GROUP BY w) a ON s.w = a.w
      GROUP BY ALL) b ON s.w = b.w
    WHERE s.p <> b.gone) y
  LEFT JOIN merges m ON y.changed AND m.pair = y.t::BIGINT * 4294967296 + y.nt
)
SELECT s.w, s.p, s.t FROM step s JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) l ON s.w = l.w AND s.i = l.i
ORDER BY s.w, s.p
"""

#: The same in place: np is the position of the next token, n the rank of the pair with it; tokens that are gone are null.
LONG_SQL = """
WITH RECURSIVE s(w, p, t, np, n) USING KEY (w, p) AS (
  SELECT x.w, x.p, x.t, x.np, m.n
  FROM (SELECT w, p, t, lead(t) OVER o AS nt, lead(p) OVER o AS np FROM pieces WINDOW o AS (PARTITION BY w ORDER BY p)) x
  LEFT JOIN merges m ON m.pair = x.t::BIGINT * 4294967296 + x.nt
  UNION (
  WITH best AS (SELECT w, min(n) AS n FROM recurring.s GROUP BY w),
  hits AS (SELECT s.w, s.p, s.np, s.n, CASE WHEN lag(s.np) OVER (PARTITION BY s.w ORDER BY s.p) = s.p THEN 0 ELSE 1 END AS opens
    FROM recurring.s s JOIN best b ON s.w = b.w AND s.n = b.n),
  islands AS (SELECT *, sum(opens) OVER (PARTITION BY w ORDER BY p) AS island, row_number() OVER (PARTITION BY w ORDER BY p) AS place FROM hits),
  chosen AS (SELECT w, p, np AS q, n AS made FROM islands
    QUALIFY row_number() OVER (PARTITION BY w, island ORDER BY p) % 2 = 1 AND (place = 1 OR NOT EXISTS (FROM early e WHERE e.t = n))),
  c AS (SELECT c.w, c.p, c.q, c.made, s.np AS r FROM chosen c JOIN recurring.s s ON s.w = c.w AND s.p = c.q),
  changed AS (
    SELECT c.w, c.p, c.made AS t, c.r AS np, coalesce(e.made, s.t) AS nt
    FROM c LEFT JOIN c e ON e.w = c.w AND e.p = c.r LEFT JOIN recurring.s s ON s.w = c.w AND s.p = c.r
    UNION ALL
    SELECT x.w, x.p, x.t, x.np, c.made FROM recurring.s x JOIN c ON x.w = c.w AND x.np = c.p
    WHERE x.t IS NOT NULL AND NOT EXISTS (FROM c g WHERE g.w = x.w AND g.q = x.p))
  SELECT d.w, d.p, d.t, d.np, m.n FROM changed d LEFT JOIN merges m ON m.pair = d.t::BIGINT * 4294967296 + d.nt
  UNION ALL SELECT w, q, NULL, NULL, NULL FROM c)
)
SELECT w, p, t FROM s WHERE t IS NOT NULL ORDER BY w, p
"""

DECODE_SQL = """
SELECT d, unhex(string_agg(b, '' ORDER BY p)) AS bytes FROM tokens JOIN vocabulary USING (t) GROUP BY d ORDER BY d
"""


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pattern's class of every code point: letter, number, white space or other."""
    import sys
    import unicodedata

    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = _SPACE
    return out


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All pieces of the texts by the pattern: their bytes, the byte offsets (one more than pieces) and each piece's text.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, worked out over
    arrays of code points.
    """
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _classes()[cp]
    edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[edges] = _EDGE
    n = len(cp)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _EDGE, kind[:-1]
    start = kind != before
    space = kind == _SPACE
    # the last white space of a run before other text stands alone or, if it is a blank, opens the next piece
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = _EDGE, kind[1:]
    last = space & (after != _SPACE) & (after != _EDGE)
    start |= last
    blank = last & (cp == 32)
    follows = np.flatnonzero(blank) + 1
    start[follows] = False
    # contractions: only where an apostrophe begins a piece
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(2, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for at, length in ((quote[short], 2), (quote[long], 3)):
            start[at + 1] = False
            ends = at + length
            inner = ends[(kind[np.minimum(ends, n - 1)] == _LETTER)]
            start[inner] = True
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    byte = np.cumsum(width) - width
    at = np.flatnonzero(start)
    data = joined.encode("utf-8")
    offsets = np.append(byte[at], len(data)).astype(np.int32)
    owner = np.searchsorted(edges, at, side="left").astype(np.int32)
    owner[kind[at] == _EDGE] = -1
    return data, offsets, owner


def cuts(text: str, chunk: int) -> Iterator[str]:
    """A text in parts of some ``chunk`` characters, cut where a single blank stands between others: a piece begins there."""
    at = 0
    while len(text) - at > chunk and (m := _CUT.search(text, at + chunk)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Coder:
    """Encodes and decodes with one rank table; lives as long as its worker."""

    def __init__(self, path: str, limits: Limits = Limits()):
        import duckdb

        self.limits = limits

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = {i: b for b, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, new = [], [], []
        for b, i in self.ranks.items():
            for k in range(1, len(b)):
                x, y = self.ranks.get(b[:k]), self.ranks.get(b[k:])
                if x is not None and y is not None:
                    left.append(x), right.append(y), new.append(i)
        left, right, new = (np.array(x, np.int64) for x in (left, right, new))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self._make("merges", pa.table({"pair": left * 4294967296 + right, "n": new.astype(np.int32)}))
        self._make("early", pa.table({"t": np.unique(np.concatenate([left[new < left], right[new < right]])).astype(np.int32)}))
        self._make("vocabulary", pa.table({"t": np.array(list(self.ranks.values()), np.int32), "b": [b.hex() for b in self.ranks]}))
        self.reset()

    def _make(self, name: str, data: pa.Table) -> None:
        self.db.register("incoming", data)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.starts, self.sizes, self.total = [], [], 0

    def _keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts)
        ends = np.cumsum(sizes)
        self.starts += (self.total + ends - sizes).tolist()
        self.sizes += sizes.tolist()
        self.parts.append(ids.astype(np.int32))
        self.total += len(ids)
        self.known.update(zip(words, range(first, first + len(words))))

    def by_rows(self, words: list[bytes], sql: str = ENCODE_SQL) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.single[np.frombuffer(b"".join(words), np.uint8)]
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        p = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self.db.register("pieces", pa.table({"w": w, "p": p, "t": flat}))
        got = self.db.execute(sql).fetchnumpy()
        self.db.unregister("pieces")
        return np.asarray(got["t"]), np.bincount(np.asarray(got["w"]), minlength=len(words))

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        whole = [w for w in new if w in self.ranks]
        if whole:
            self._keep(whole, np.fromiter(map(self.ranks.__getitem__, whole), np.int64, len(whole)), np.ones(len(whole), np.int64))
        rest = [w for w in new if w not in self.ranks and len(w) <= MAX_ROWS]
        for i in range(0, len(rest), self.limits.block):
            block = rest[i : i + self.limits.block]
            self._keep(block, *self.by_rows(block))
        for w in new:
            if len(w) > MAX_ROWS and w not in self.ranks:
                ids = self._joined(w)
                self._keep([w], ids, np.array([len(ids)]))

    def _encoded(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; distinct ones go through the query in blocks, longer ones by themselves."""
        found: dict[bytes, np.ndarray] = {}
        short = sorted({w for w in words if len(w) <= MAX_ROWS})
        for i in range(0, len(short), self.limits.block):
            block = short[i : i + self.limits.block]
            ids, sizes = self.by_rows(block)
            found.update(zip(block, np.split(ids, np.cumsum(sizes)[:-1])))
        for w in {w for w in words if len(w) > MAX_ROWS}:
            found[w] = self.by_rows([w], LONG_SQL)[0]
        return [found[w] for w in words]

    def _joined(self, word: bytes) -> np.ndarray:
        """Ids of a long piece, from those of its parts: where two parts' ids do not stand side by side, both ends are encoded together.

        Two ids stand side by side if their bytes, encoded together, give just these two. Ids of which all neighbours do are
        the ids of the whole, as a contraction depends on its neighbours alone. Each round looks further around the joints.
        """
        bytes_of = lambda ids: b"".join(map(self.vocabulary.__getitem__, ids.tolist()))
        parts = self._encoded([word[i : i + MAX_ROWS] for i in range(0, len(word), MAX_ROWS)])
        fits: dict[tuple[int, int], bool] = {}
        reach = 4
        while True:
            joints = [(int(a[-1]), int(b[0])) for a, b in zip(parts, parts[1:])]
            asked = sorted({j for j in joints if j not in fits})
            for j, ids in zip(asked, self._encoded([self.vocabulary[a] + self.vocabulary[b] for a, b in asked])):
                fits[j] = ids.tolist() == list(j)
            apart = [not fits[j] for j in joints]
            if not any(apart):
                return np.concatenate(parts)
            # ids, or the bytes of both ends of parts around joints that do not fit
            new: list[np.ndarray | bytes] = []
            open_ = b""
            for part, left, right in zip(parts, [False, *apart], [*apart, False]):
                low, high = (reach if left else 0), len(part) - (reach if right else 0)
                if low < high:
                    if left:
                        new.append(open_ + bytes_of(part[:low]))
                    new.append(part[low:high])
                    open_ = bytes_of(part[high:])
                else:
                    open_ += bytes_of(part)
                    if not right:
                        new.append(open_)
                        open_ = b""
            ends = iter(self._encoded([x for x in new if isinstance(x, bytes)]))
            parts = [next(ends) if isinstance(x, bytes) else x for x in new]
            reach *= 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if any(len(t) > self.limits.chunk for t in texts):
            parts = [(i, p) for i, t in enumerate(texts) for p in cuts(t, self.limits.chunk)]
            ids, sizes = self._blocks([p for _, p in parts])
            return ids, np.bincount([i for i, _ in parts], sizes, len(texts)).astype(np.int64)
        return self._blocks(texts)

    def _blocks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [], []
        i = 0
        while i < len(texts):
            j, room = i, self.limits.chunk
            while j < len(texts) and (j == i or len(texts[j]) <= room):
                room -= len(texts[j])
                j += 1
            ids, size = self._encode(texts[i:j])
            out.append(ids), sizes.append(size)
            i = j
        return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, offsets, owner = split(texts)
        pieces = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if len(self.known) > self.limits.memory:
            self.reset()
        self.learn(words)
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        known = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = np.array(self.starts, np.int64)[known] if len(self.starts) < 4 * len(known) else np.fromiter(map(self.starts.__getitem__, known.tolist()), np.int64, len(known))
        sizes = np.fromiter(map(self.sizes.__getitem__, known.tolist()), np.int64, len(known))
        code = pieces.indices.to_numpy()[owner >= 0]
        owner = owner[owner >= 0]
        size = sizes[code]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(starts[code] - (ends - size), size) + np.arange(total)
        ids = self.parts[0][index].astype("<u4") if self.parts else np.zeros(0, "<u4")
        return ids, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each of the id sequences that lie one after the other in ids."""
        # runs of at most RUN ids, a sequence's runs one after the other
        many = np.maximum(1, -(-sizes // RUN))
        owner = np.repeat(np.arange(len(sizes)), many)
        last = np.cumsum(many) - 1
        runs = np.full(len(owner), RUN, np.int64)
        runs[last] = sizes - (many - 1) * RUN
        parts: list[list[bytes]] = [[] for _ in range(len(sizes))]
        ends = np.cumsum(runs)
        i = 0
        while i < len(runs):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + RUN)))
            a, b = int(ends[i] - runs[i]), int(ends[j - 1])
            d = np.repeat(np.arange(i, j, dtype=np.int32), runs[i:j])
            self.db.register("tokens", pa.table({"d": d, "p": np.arange(b - a, dtype=np.int64), "t": ids[a:b].astype(np.int32)}))
            for k, x in self.db.execute(DECODE_SQL).fetchall():
                parts[owner[k]].append(x)
            self.db.unregister("tokens")
            i = j
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


@lru_cache(maxsize=2)
def coder(path: str, limits: Limits = Limits()) -> Coder:
    return Coder(path, limits)


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _schema(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in columns] + [T.StructField(n, t) for n, t in columns.items()])


def _pack(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes) * 4
    return [raw[e - 4 * s : e] for e, s in zip(ends.tolist(), sizes.tolist())]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` of column ``text``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = coder(path).encode(_texts(batch.column(batch.schema.names.index(text))))
            yield _with(batch, ids=pa.array(_pack(ids, sizes), pa.binary()), n_tokens=pa.array(sizes, pa.int64()))

    return df.mapInArrow(lean(run), _schema(df, ids=T.BinaryType(), n_tokens=T.LongType()))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary) of column ``ids`` as :func:`encode` makes it; null ids count as none."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            sizes = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
            out = coder(path).decode(np.frombuffer(b"".join(raw), "<u4"), sizes)
            yield _with(batch, decoded=pa.array(out, pa.binary()))

    return df.mapInArrow(lean(run), _schema(df, decoded=T.BinaryType()))


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limits: Limits = Limits()) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: :func:`encode` and :func:`decode` in one pass that keeps digests only."""
    ship(df.sparkSession)
    hexed = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = coder(path, limits).encode(_texts(batch.column(1)))
            yield pa.RecordBatch.from_pydict({
                key: batch.column(0), "n_tokens": pa.array(sizes, pa.int64()),
                "ids_sha256": hexed(_pack(ids, sizes)), "decoded_sha256": hexed(coder(path, limits).decode(ids, sizes)),
            })

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(lean(run), schema)
