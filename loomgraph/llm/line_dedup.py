"""Line deduplication by pairwise alignment.

A line is what lies between line ends, cut further at the ends of sentences. A passage is a shortest run of lines with
``BLOCK`` words or more, from a line on or up to a line; a long line is one by itself. Passages are told by the hash of
their lines, and the number of documents that hold each is counted over all documents. One that several hold pairs each
later document with an earlier holder: a rare one, of at most ``RARE`` documents, with the last holder before it, a more
frequent one with the first, so that what is in n documents makes n - 1 pairs and no group of holders is ever gathered.

Each pair is aligned by patience diff over the passages they share: the longest chain that ascends in both texts comes
first, and what lies off it, as it is repeated or in another order, is dealt into further ascending chains by patience
sorting. Neighbours of a chain that are neighbours in both texts make a block. Every block is a run of BLOCK words or
more that one earlier document holds. Of all partners' blocks the longest come first; one whose lines longer ones have
between them is left out. The blocks that are chosen are what is deleted, and what the output tells: first line and end
of each, its partner and its first line there.

Which holder a document is paired with does not change what it loses: every holder of a passage has the whole of it, and
a run of BLOCK words or more is covered by the passages in it. So exactly the lines go that are in a run of BLOCK words
or more, unbroken in one earlier document; nothing is united over several partners before it is measured.

Defined cases: a null text has no lines and stays null; the earlier of two documents is that with the smaller doc_id;
rows of one doc_id are not compared with one another, and rows without one with none; a text may lose all its lines and
stays as an empty text; an empty table gives no rows; other columns pass through unchanged, and a report column whose
name is taken gets underscores at its end.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, lean, ship, written
from .text import NOT_SPACE, SLICE, Joined, chunks, hashes, mix, sums

#: Words of a passage.
BLOCK = 20
#: Documents that hold a rare passage at most.
RARE = 32
#: Numbers of 4 bytes, of blocks to delete, that may be broadcast; beyond that documents are shuffled.
BROADCAST_LINES = 2_000_000
#: Columns that tell what a text has lost.
REPORT = ("removed_lines", "removed_words", "partners", "blocks")


def lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' lines: begin and end within the text, hash, number of words; and where each text's lines begin.

    A line ends at a line end, and at blanks that follow one or the end of a sentence. Work goes in slices, so that a long
    text takes little more than itself and its lines.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    found, last, divides, open_ = Joined(), 10, True, False
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        before = np.empty_like(part)
        before[0], before[1:] = last, part[:-1]
        cut = part == 10
        blank = (part == 32) | (part == 9)
        opens = blank & ~((before == 32) | (before == 9))
        # of each run of blanks, the one that goes on from the slice before first: whether it divides lines
        ends = np.concatenate([[divides], np.isin(before[opens], np.frombuffer(b"\n.!?", np.uint8))])
        cut[blank] = ends[np.cumsum(opens)[blank]]
        change = np.flatnonzero(np.diff(np.concatenate([[True], cut, [True]]).view(np.int8)))
        begin, end = change[::2], change[1::2]
        total = np.concatenate([[0], np.cumsum(NOT_SPACE[part] & ~NOT_SPACE[before])])
        found.add(at, begin, end, sums(part.astype(np.uint64) + np.uint64(1), begin, end), total[end] - total[begin], open_ and not cut[0])
        last, divides, open_ = part[-1], bool(ends[-1]), not cut[-1]
    begin, end, hashed, words = found.ranges()
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    starts = np.searchsorted(begin, edges)
    shift = np.repeat(edges[:-1], np.diff(starts))
    return begin - shift, end - shift, hashed.view(np.int64), words, starts


def windows(hashed: np.ndarray, words: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages of all texts, in order: first line, end, and a hash that depends on the lines alone."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + least)
    begins = np.searchsorted(total, total[1:] - least, "right") - 1
    sizes = np.diff(starts)
    on = np.flatnonzero(ends <= np.repeat(starts[1:], sizes))
    up = np.flatnonzero(begins >= np.repeat(starts[:-1], sizes))
    up = up[ends[begins[up]] != up + 1]
    begin, end = np.concatenate([on, begins[up]]), np.concatenate([ends[on], up + 1])
    order = np.lexsort((end, begin))
    begin, end = begin[order], end[order]
    return begin, end, hashes(sums(hashed.view(np.uint64), begin, end), end - begin).view(np.int64)


def chains(there: list[int]) -> list[int]:
    """The chain of each place of a sequence: 0 for a longest ascending one, others for what that leaves out.

    The rest is dealt as in patience sorting: each place goes onto the chain whose last value is the largest below its own.
    """
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(there)
    for n, y in enumerate(there):
        k = bisect_left(tails, y)
        back[n] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(y), at.append(n)
        else:
            tails[k], at[k] = y, n
    out = [-1] * len(there)
    n = at[-1] if at else -1
    while n >= 0:
        out[n] = 0
        n = back[n]
    # the other chains by their last values, descending, as negative numbers
    lasts: list[int] = []
    for n, y in enumerate(there):
        if out[n] < 0:
            k = bisect_right(lasts, -y)
            if k == len(lasts):
                lasts.append(-y)
            lasts[k] = -y
            out[n] = k + 1
    return out


def passages(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, version, hash, begin, end, kind`` of each passage of every row with a doc_id.

    version tells texts of one doc_id apart; kind is 0 where the text has the passage further ahead as well.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                _, _, hashed, words, starts = lines(texts)
                begin, end, key = windows(hashed, words, starts, block)
                text = np.searchsorted(starts, begin, "right") - 1
                _, head = np.unique(mix(key.view(np.uint64) + mix(text.astype(np.uint64))), return_index=True)
                kind = np.zeros(len(key), np.int8)
                kind[head] = 1
                own = pa.array(first + text)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(own), "version": batch.column(2).take(own), "hash": pa.array(key),
                    "begin": pa.array(begin - starts[text], pa.int32()), "end": pa.array(end - starts[text], pa.int32()), "kind": pa.array(kind),
                })

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    return rows.mapInArrow(lean(run), "doc_id long, version long, hash long, begin int, end int, kind tinyint")


def paired(docs: DataFrame, block: int = BLOCK, rare: int = RARE) -> tuple[DataFrame, list[DataFrame]]:
    """``doc_id, version, partner, begin, end, there`` of each passage that an earlier document holds, and scratch tables.

    there is the first line of the passage in the partner. Holders of one passage meet in its own group only if it is rare.
    """
    known = written(passages(docs, block), "passages")
    heads = known.where("kind = 1").groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.min_by("begin", "doc_id").alias("there"))
    held = written(known.join(heads.where("first < last").select("hash", "first", "n", "there"), "hash"), "held")
    before = Window.partitionBy("hash").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    nearest = F.max(F.struct(F.when(F.col("kind") == 1, F.col("doc_id")).alias("doc_id"), "begin")).over(before)
    few = held.where(F.col("n") <= rare).withColumn("earlier", nearest).where("earlier.doc_id is not null")
    many = held.where((F.col("n") > rare) & (F.col("doc_id") > F.col("first")))
    names = ["doc_id", "version", "partner", "begin", "end", "there"]
    out = few.select("doc_id", "version", F.col("earlier.doc_id").alias("partner"), "begin", "end", F.col("earlier.begin").alias("there"))
    return out.select(*names).unionByName(many.withColumnRenamed("first", "partner").select(*names)), [known, held]


BLOCKS = "array<struct<begin: int, end: int, partner: bigint, there: int>>"


def aligned(docs: DataFrame, block: int = BLOCK, rare: int = RARE) -> DataFrame:
    """``doc_id, version, blocks`` of each document that loses any: first line and end of each block, the partner that
    holds it, and its first line there. Chosen blocks may overlap, but none lies within others."""
    rows, scratch = paired(docs, block, rare)
    order = ["doc_id", "version", "partner", "begin", "end"]
    sorted_ = rows.repartition("doc_id", "version").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, version = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.flatnonzero((doc[1:] != doc[:-1]) | (version[1:] != version[:-1])) + 1
            if last != (doc[0], version[0]):
                new = np.concatenate([[0], new])
            # the last document may go on in the next batch
            if len(new):
                held.append(batch.slice(0, int(new[-1])))
                done = pa.Table.from_batches(held)
                if done.num_rows:
                    yield _blocks(done)
                held = []
            held.append(batch.slice(int(new[-1]) if len(new) else 0))
            last = (doc[-1], version[-1])
        if held:
            yield _blocks(pa.Table.from_batches(held))

    out = written(sorted_.mapInArrow(lean(run), f"doc_id long, version long, blocks {BLOCKS}"), "blocks")
    forget(*scratch)
    return out


def _blocks(table: pa.Table) -> pa.RecordBatch:
    """The blocks of documents from the passages that they share with partners, sorted."""
    doc, version, partner, begin, end, there = (table.column(i).to_numpy() for i in range(6))
    # rows that are repeated have equal passages
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (version[1:] == version[:-1]) & (partner[1:] == partner[:-1]) & (begin[1:] == begin[:-1]) & (end[1:] == end[:-1])
    doc, version, partner, begin, end, there = (x[~again] for x in (doc, version, partner, begin, end, there))
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    new_pair = new_doc.copy()
    new_pair[1:] |= partner[1:] != partner[:-1]
    pair = np.cumsum(new_pair) - 1
    starts = np.append(np.flatnonzero(new_pair), len(doc))
    # passages that begin on one line follow each other in both texts, so that the line decides, then the end
    place = there.astype(np.int64) * (1 << 31) + end - begin
    falls = np.flatnonzero(~new_pair[1:] & (place[1:] <= place[:-1]))
    chain = np.zeros(len(doc), np.int64)
    for k in np.unique(pair[falls]).tolist():
        chain[starts[k] : starts[k + 1]] = chains(place[starts[k] : starts[k + 1]].tolist())
    turn = np.lexsort((np.arange(len(doc)), chain, pair))
    pair, chain, doc, version, partner, begin, end, there = (x[turn] for x in (pair, chain, doc, version, partner, begin, end, there))
    opens = np.ones(len(doc), bool)
    opens[1:] = (pair[1:] != pair[:-1]) | (chain[1:] != chain[:-1]) | (begin[1:] > end[:-1]) | (begin[1:] - there[1:] != begin[:-1] - there[:-1])
    at = np.flatnonzero(opens)
    till = np.append(at[1:], len(doc)) - 1
    keep = np.array(chosen(doc[at], version[at], begin[at], end[till], partner[at]), np.int64)
    at, till = at[keep], till[keep]
    new = np.ones(len(at), bool)
    new[1:] = (doc[at][1:] != doc[at][:-1]) | (version[at][1:] != version[at][:-1])
    heads = np.flatnonzero(new)
    fields = [pa.array(begin[at], pa.int32()), pa.array(end[till], pa.int32()), pa.array(partner[at], pa.int64()), pa.array(there[at], pa.int32())]
    blocks = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), pa.StructArray.from_arrays(fields, ["begin", "end", "partner", "there"]))
    return pa.RecordBatch.from_arrays([pa.array(doc[at][heads]), pa.array(version[at][heads]), blocks], ["doc_id", "version", "blocks"])


def chosen(doc: np.ndarray, version: np.ndarray, begin: np.ndarray, end: np.ndarray, partner: np.ndarray) -> list[int]:
    """Of the blocks of documents, which are kept: in each document the longest first, those of equal length by partner and place, unless kept ones have all of its lines."""
    out: list[int] = []
    edges = np.flatnonzero((doc[1:] != doc[:-1]) | (version[1:] != version[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(doc)]):
        if b - a < 2:
            out += range(a, b)
            continue
        low = int(begin[a:b].min())
        taken = np.zeros(int(end[a:b].max()) - low, bool)
        kept = []
        for i in (a + np.lexsort((begin[a:b], partner[a:b], begin[a:b] - end[a:b]))).tolist():
            lines_ = taken[begin[i] - low : end[i] - low]
            if not lines_.all():
                lines_[:] = True
                kept.append(i)
        out += sorted(kept, key=lambda i: (begin[i], end[i]))  # noqa: B023
    return out


def gone(blocks: list[dict]) -> list[int]:
    """The numbers of the lines in blocks."""
    return sorted({i for b in blocks for i in range(b["begin"], b["end"])})


def without(text: bytes, gone: list[int]) -> tuple[bytes, int]:
    """A text without the lines of these numbers, and the words in them; what divides a line from the next goes with it."""
    begin, _, _, words, _ = lines([text])
    begin = [*begin.tolist(), len(text)]
    at = set(gone)
    out = text[: begin[0]] + b"".join(text[x:y] for i, (x, y) in enumerate(zip(begin, begin[1:])) if i not in at)
    return (out.rstrip(b"\n\t ") if len(begin) - 2 in at else out), int(words[gone].sum())


def report_names(columns: list[str]) -> list[str]:
    """Names of the report columns beside these columns."""
    out = []
    for name in REPORT:
        while name in columns or name in out:
            name += "_"
        out.append(name)
    return out


def deduplicated(docs: DataFrame, block: int = BLOCK, rare: int = RARE) -> DataFrame:
    """``docs`` with its texts' repeated blocks deleted, and columns :func:`report_names`."""
    found = aligned(docs, block, rare).select(F.col("doc_id").alias("doc"), "version", "blocks")
    few = (found.agg(F.sum(5 * F.size("blocks") + 8)).first()[0] or 0) <= BROADCAST_LINES
    keyed = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    joined = keyed.join(F.broadcast(found) if few else found, ["doc", "version"], "left")
    at, number = docs.columns.index("text"), len(docs.columns)
    fields = [F.col("row").getField(n) for n in docs.columns]
    fields[at] = fields[at].cast("string")
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields])
    for n, t in zip(report_names(docs.columns), (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), found.schema["blocks"].dataType)):
        schema = schema.add(n, t)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            removed, words, partners = [0] * len(texts), [0] * len(texts), [[]] * len(texts)
            changed = {}
            for i, blocks in enumerate(batch.column(number).to_pylist()):
                if blocks:
                    text, lost = texts[i].as_py().encode(), gone(blocks)
                    kept, words[i] = without(text, lost)
                    changed[i], removed[i] = kept.decode(), len(lost)
                    partners[i] = sorted({b["partner"] for b in blocks})
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
            own = pa.array([b or [] for b in batch.column(number).to_pylist()], batch.column(number).type)
            report = [pa.array(removed, pa.int64()), pa.array(words, pa.int64()), pa.array(partners, pa.list_(pa.int64())), own]
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(number)] + report, names)

    rows = joined.select(*[f.alias(f"c{i}") for i, f in enumerate(fields)], F.col("blocks").alias("blocks"))
    return rows.mapInArrow(lean(run), schema)
