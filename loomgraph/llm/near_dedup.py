"""MinHash near-duplicates with odd sketches.

Each text becomes its set of distinct word shingles. Texts with equal sets are one node. MinHash values of a set give
``BANDS`` band keys of ``ROWS`` values each. Of the nodes that share a key with another, ``SAMPLES`` further MinHash
values are folded, by parity, into a bitmap, the odd sketch: the population count of two bitmaps' XOR estimates the
similarity, most precisely where it is high, and pairs that it puts clearly below the threshold are left out before any
text is compared. The rest are confirmed on their full shingle sets; links give connected components.

No bucket is expanded into all pairs. A first round tries every node against the least node of each of its buckets;
``PIVOTS`` rounds try what is not yet connected to the main component of its bucket against one changing member of that
component; what is then left apart is compared by sketch across components only, and each pair that passes is
confirmed. So no link between texts that share a key is lost: they are compared, or connected already. Two texts of
similarity 0.75 share no key, or fail the sketch, with a chance of some four in a million.

Defined cases: a null text is an empty one; texts without words have no shingles and are linked with nothing; equal
rows and rows of one doc_id are one node; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, ship, written
from .components import BROADCAST_LABELS, components
from .text import NOT_SPACE, chunks, mix, shingles

BANDS, ROWS = 64, 6
#: MinHash values in an odd sketch, and its bits.
SAMPLES, BITS = 2048, 4096
#: Rounds against a changing member of each bucket's main component.
PIVOTS = 1
#: Sets that are sketched at once.
SETS = 400
#: Shingle hashes that are permuted at once.
BLOCK = 65_536
#: Sketches that may be broadcast (BITS / 8 bytes each); more are joined by shuffles.
BROADCAST_SKETCHES = 20_000
#: Members of a bucket that are compared at once, by sketch, with as many others.
SQUARE = 512
#: Ids that may be broadcast to filter texts (8 bytes each); beyond that the filter is a shuffled join.
BROADCAST_IDS = 1_000_000


@lru_cache(maxsize=2)
def _permutations(many: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix((np.arange(1, 2 * many + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:many] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[many:] >> np.uint64(32)).astype(np.uint32)


def minhash(sets: list[np.ndarray], many: int, seed: int = 0) -> np.ndarray:
    """many values, a row each, for each of the sets, none of which is empty."""
    a, b = _permutations(many, seed)
    out = np.empty((many, len(sets)), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= BLOCK):
            n += len(sets[j])
            j += 1
        flat = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        room = np.empty_like(flat)
        for k in range(many):
            np.bitwise_xor(flat, b[k], out=room)
            np.multiply(room, a[k], out=room)
            out[k, i:j] = np.minimum.reduceat(room, starts)
        i = j
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """BANDS keys for each column of values."""
    keys = np.empty((BANDS, values.shape[1]), np.uint64)
    for k in range(BANDS):
        key = np.full(values.shape[1], k + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[k * ROWS + r])
        keys[k] = key
    return keys.view(np.int64).T


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """For each column, the parity bitmap of its (row, value) pairs, as BITS / 64 integers."""
    many, n = values.shape
    place = mix(values.astype(np.uint64) + (np.arange(many, dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(BITS)
    cells = np.bincount((place.astype(np.int64) + np.arange(n) * BITS).ravel(), minlength=n * BITS) & 1
    bits = cells.reshape(n, BITS // 64, 64).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8").reshape(n, BITS // 64).view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """The XOR population count that a pair of this similarity exceeds with a chance below one in a million.

    Of SAMPLES values a binomial number differ, each in two pairs, and the pairs' cells collide: five standard deviations
    of both together are let through.
    """
    differ = 2 * SAMPLES * (1 - similarity)
    decay = np.exp(-2 * differ / BITS)
    mean = BITS / 2 * (1 - decay)
    sampled = (2 * decay) ** 2 * SAMPLES * similarity * (1 - similarity)
    collided = BITS / 4 * (1 - decay**2) - differ * decay**2
    return int(mean + 5 * (sampled + max(0.0, collided)) ** 0.5) + 1


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """Of each row: the number of shingles, a 128-bit digest of the set, and band keys (null without shingles)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                sets = shingles(texts, size, NOT_SPACE)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = dict(zip(full, band_keys(minhash([sets[i] for i in full], BANDS * ROWS)))) if full else {}
                digest = [(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5A5A5A)).sum(dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(first, len(texts)).cast(pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "d1": pa.array(np.array([d[0] for d in digest], np.uint64).view(np.int64)), "d2": pa.array(np.array([d[1] for d in digest], np.uint64).view(np.int64)),
                    "keys": pa.array([keys.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                })

    return docs.select("doc_id", "text").mapInArrow(lean(run), SIGNED)


def sketched(texts: DataFrame, size: int) -> DataFrame:
    """``node, text, sketch`` of node, text; texts without shingles are left out."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in chunks(batch.column(1)):
                sets = shingles(block, size, NOT_SPACE)
                every = [i for i, s in enumerate(sets) if len(s)]
                for at in range(0, len(every), SETS):
                    full = every[at : at + SETS]
                    kept = batch.slice(first, len(block)).take(pa.array(full))
                    odd = odd_sketch(minhash([sets[i] for i in full], SAMPLES, 1))
                    yield pa.RecordBatch.from_pydict({"node": kept.column(0), "text": kept.column(1), "sketch": pa.array(list(odd), pa.list_(pa.int64()))})

    return texts.select("node", "text").mapInArrow(lean(run), "node long, text string, sketch array<long>")


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    values = pc.fill_null(column, "").cast(pa.binary()).to_pylist()
    out, last, known = [], None, None
    for v in values:
        if v != last:
            last, known = v, shingles([v], size, NOT_SPACE)[0]
        out.append(known)
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _sets(batch.column(2), size), _sets(batch.column(3), size)
            common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64) - common
            yield batch.select([0, 1]).filter(pa.array((100 * common >= percent * union) & (union > 0)))

    few = F.broadcast(pairs) if pairs.count() <= BROADCAST_LABELS else pairs
    own, other = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = own.join(few, "a").join(other, "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def _close(most: int):
    """The odd sketches x and y differ in few enough bits."""
    return reduce(add, [F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(BITS // 64)]) <= most


def across(members: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of members (key, n, node, label, sketch, keys) of a bucket that differ in label and pass the sketch.

    A bucket of n members is laid out in squares of SQUARE members on either side, one task each, and a pair is given in
    the first of its common buckets alone, so that what comes out are the distinct pairs that pass.
    """
    sides = F.ceil(F.col("n") / SQUARE).cast("int")
    own = F.pmod(F.xxhash64("node"), sides.cast("long")).cast("int")
    squares = F.explode(F.transform(F.sequence(F.lit(0), F.col("_sides") - 1), lambda i: F.struct(F.least("_own", i).alias("i"), F.greatest("_own", i).alias("j"))))
    laid = members.withColumn("_sides", sides).withColumn("_own", own).withColumn("_square", squares).select("key", "_square.i", "_square.j", "_own", "node", "label", "sketch", "keys")

    def compare(group: pa.Table) -> pa.Table:
        own, i, j = (group.column(c).to_numpy() for c in ("_own", "i", "j"))
        node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
        sketch = np.stack(group.column("sketch").to_numpy()).view(np.uint64)
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        found = []
        key = group.column("key")[0].as_py()
        keys = None
        for x in left:
            others = right[(label[right] != label[x]) & ((node[right] > node[x]) if i[0] == j[0] else True)]
            if len(others):
                near = others[np.bitwise_count(sketch[others] ^ sketch[x]).sum(axis=1, dtype=np.int64) <= most]
                if len(near):
                    keys = keys or [np.asarray(k) for k in group.column("keys").to_pylist()]
                    found += [(min(node[x], node[y]), max(node[x], node[y])) for y in near if np.intersect1d(keys[x], keys[y]).min() == key]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return laid.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; see the module's docstring."""
    most = most_odd_bits(percent / 100)
    signed = written(signatures(docs, size), "signatures")
    # repeated rows and equal sets first: one node for each set
    groups = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys"))
    rows = groups.where("node is not null").select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").drop("n")
    buckets = written(rows.join(shared, "key"), "buckets")
    ids = written(buckets.groupBy("node").agg(F.collect_list("key").alias("keys")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    # of rows that bear one doc_id, each text is tried
    texts = texts.join(F.broadcast(ids.select("node")) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")
    texts = written(sketched(texts, size), "texts")

    sketches = texts.select("node", "sketch")
    light = F.broadcast if sketches.count() <= BROADCAST_SKETCHES else lambda df: df

    def passing(pairs: DataFrame) -> DataFrame:
        own = light(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")))
        other = light(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")))
        return pairs.join(own, "a").join(other, "b").where(_close(most)).select("a", "b")

    # the least node of a bucket that a node resembles
    first = passing(buckets.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    tried = [written(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")]
    links = [written(confirmed(tried[0], texts, size, percent), "links")]
    labels = components(links[0])
    open_ = buckets.select("key", "node")
    for turn in range(PIVOTS + 1):
        sent = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
        named = open_.join(sent, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        # main: of each bucket with several components the largest, and a member of it that changes with the turn
        sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
        main = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label", "pivot")).alias("main")).where("labels > 1")
        main = written(main.select("key", "n", F.col("main.label").alias("main"), F.col("main.pivot").alias("pivot")), "main")
        few = F.broadcast(main) if main.count() <= BROADCAST_LABELS else main
        # buckets of one component are done with
        rest = written(named.join(few, "key"), "rest")
        open_ = rest.select("key", "node")
        if turn < PIVOTS:
            pairs = passing(rest.where("label <> main").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = across(rest.select("key", "n", "node", "label").join(light(sketches), "node").join(ids, "node"), most)
        tried.append(written(pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"), "tried"))
        if tried[-1].limit(1).count():
            links.append(written(confirmed(tried[-1], texts, size, percent), "links"))
            if links[-1].limit(1).count():
                labels = components(reduce(DataFrame.union, links))
    least = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    # a table, so that a hot set of copies meets it in a join that Spark can split
    named = written(least.join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("label")), "named")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2").join(named, ["d1", "d2"], "left")
    forget(buckets, ids, texts, *tried, *links)
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Of each component the document with the smallest doc_id, with all rows that bear it; rows without doc_id stay."""
    found = near_duplicates(docs, size, percent)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")
