"""Resampling of documents towards a target distribution, by importance weights of hashed word runs.

The features of a text are its runs of 1 to ``longest`` words, repeats counted. A run's bucket is the CRC-32 of its words
joined by one space, modulo ``buckets``. One scan of a text keeps a ring of running CRC states, one for each of the last
starts: the next word extends each of them by a space and itself, and begins one of its own, so that no run is ever put
together as a string. What the scan emits are buckets.

The first pass counts buckets over all documents and all texts of the target, each task in an array of ``buckets`` sums.
A bucket's gain is the scaled logarithm of its share in the target over that in the documents, smoothed by one of each. The
second pass adds up each document's gains. A Gumbel number, made of the hash of the doc_id, turns the weights into a draw
without replacement: the highest sums of both are drawn. Ranks are given in two phases, by ranges of scores and then by
offsets, so that no task sees all rows.

Defined cases: a null text is an empty one, with no features and weight 0; a null doc_id is hashed as an empty string and
ranks before others of its score; texts of any length are scanned in slices of ``SLICE`` bytes, cut between words; rows of one doc_id have
the same Gumbel number, and of equal rows any comes first; without documents there are no rows, and without a target, or
with an empty one, every gain follows the same formula with counts of 0; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, parts, ship, written
from .text import chunks

BUCKETS = 10_000
#: Bytes of a text whose words are listed at once.
SLICE = 1 << 18
#: What the logarithms are multiplied by before they are rounded down.
SCALE = 1000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# A-Z are lower-cased before
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_OUTSIDE = re.compile(rb"[^0-9a-z\x80-\xff]")


def hashes(text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a text, slice by slice: how many words begin there, and the CRC-32 of each run of 1 to ``longest`` words that ends there."""
    data, crc, at = text.translate(_LOWER), zlib.crc32, 0
    ring: list[int] = []
    while at < len(data):
        cut = _OUTSIDE.search(data, at + SLICE)
        stop = cut.start() if cut else len(data)
        words = _WORD.findall(data, at, stop)
        begun = list(map(crc, words))
        out = begun if longest == 1 else []
        for word, state in zip(words, begun) if longest > 1 else ():
            ring = [crc(word, crc(b" ", s)) for s in ring]
            ring.append(state)
            out += ring
            if len(ring) == longest:
                # the oldest start has given its longest run
                del ring[0]
        yield len(words), np.array(out, np.int64)
        at = stop


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Every task adds up its own texts; ``buckets`` sums reach the driver."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, block in chunks(batch.column(0)):
                for t in block:
                    for _, found in hashes(t, longest):
                        total += np.bincount(found % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 * ln of its smoothed share in the target over that in the source)."""
    n = len(source)
    all_s, all_t = int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n))
    return np.array([math.floor(SCALE * math.log(ratio(int(s), int(t)))) for s, t in zip(source, target)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row: weight is the sum of its features' gains."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for first, block in chunks(batch.column(1)):
                rows = np.zeros((len(block), 3), np.int64)
                for row, t in zip(rows, block):
                    for begun, found in hashes(t, longest):
                        row += (begun, len(found), gain[found % len(gain)].sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), *map(pa.array, rows.T.copy())], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln u)), where u comes from the first 32 bits of sha256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1.0 * SCALE) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in that order: dealt by range, numbered within each range, and moved by an offset.

    The ranges are a written table, so that a lost executor can't change the places that others have counted on.
    """
    spark = rows.sparkSession
    at = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "ranked")
    run, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    total, offsets = 0, []
    # one row for each range
    for r in at.groupBy(run.alias("run")).count().orderBy("run").collect():
        offsets.append((r["run"], total))
        total += r["count"]
    starts = F.broadcast(spark.createDataFrame(offsets, "_run long, _start long"))
    return at.join(starts, run == F.col("_run")).withColumn(name, F.col("_start") + within + 1).drop("_at", "_run", "_start")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every row of ``docs``; target has texts alone.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn: those of the highest scores, of
    equal scores those of the smaller doc_id. rank is their place, and null for all others.
    """
    gain = gains(bucket_counts(docs, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets))
    rows = weights(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("fits", F.col("n_words") >= least_words)
    placed = ranked(rows, [F.desc("fits"), F.desc("score"), F.asc("doc_id")])
    most = percent * placed.where("fits").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (F.col("place") <= most), F.col("place")).alias("rank"), "n_words")
