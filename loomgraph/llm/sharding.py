"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows of one group (equal texts) stay together. Groups that hold more than a small share of all bytes are items of their
own; all others are dealt by the hash of their text into a fixed number of buckets, which are the remaining items. The
number of items is bounded by parameters alone, whatever the size of the table, so the differencing itself runs on the
driver: it starts with one partial partition for each item, repeatedly takes the two with the largest spread and
combines them oppositely ordered, the largest sums of one with the smallest of the other.

Slots are gapless from 0 in each shard. They are numbered within (item, salt), and a table of counts, again bounded,
gives each such run its offset; so no shard is ever gathered in one task.

Defined cases: a null text counts as an empty one; both have size 1 and share a group; repeated rows get slots of their
own; rows of one doc_id are ordered by their size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Buckets of small groups.
BUCKETS = 4096
#: A group is an item of its own from 1 / HEAVY of all bytes on; there are HEAVY such groups at most.
HEAVY = 2048
#: Runs that the rows of one item are numbered in.
SALTS = 64


def differencing(sizes: dict, shards: int) -> dict:
    """The shard of each key of sizes."""
    order = count()
    heap = []
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        sums = [size] + [0] * (shards - 1)
        heap.append((-size, next(order), sums, [[key]] + [[] for _ in range(shards - 1)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = sorted(zip([p + q for p, q in zip(a, reversed(b))], [(p, q) for p, q in zip(x, reversed(y))]), key=lambda s: -s[0])
        sums = [s for s, _ in both]
        low = sums[-1]
        heapq.heappush(heap, (low - sums[0], next(order), [s - low for s in sums], [list(m) for _, m in both]))
    out: dict = {}
    for shard, members in enumerate(heap[0][3] if heap else []):
        todo = [members]
        while todo:
            m = todo.pop()
            if isinstance(m, list):
                todo += m
            else:
                out[m] = shard
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(text))
    # texts are read once; all that follows works on these few bytes of each
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), digest.alias("digest")), "sizes")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("int")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = [(bytes(r[0]), r[1]) for r in groups.where(F.col("size") * HEAVY > total).collect()]
    named = spark.createDataFrame([(bytearray(d), BUCKETS + i) for i, (d, _) in enumerate(heavy)], "digest binary, own int")
    # at most HEAVY rows of 20 bytes are broadcast here, at most (BUCKETS + HEAVY) * SALTS further on
    dealt = rows.join(F.broadcast(named), "digest", "left").select("doc_id", "size", "text_crc32", F.coalesce("own", bucket).alias("item"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.when(F.col("item") >= BUCKETS, F.lit(SALTS)).otherwise(F.lit(1))).cast("int"))
    runs = dealt.groupBy("item", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    sizes: dict[int, int] = {}
    for r in runs:
        sizes[r["item"]] = sizes.get(r["item"], 0) + r["size"]
    placed = differencing(sizes, shards)
    offsets, used = [], [0] * shards
    for r in sorted(runs, key=lambda r: (r["item"], r["salt"])):
        s = placed[r["item"]]
        offsets.append((r["item"], r["salt"], s, used[s]))
        used[s] += r["n"]
    starts = spark.createDataFrame(offsets, "item int, salt int, shard int, start long")
    number = F.row_number().over(Window.partitionBy("item", "salt").orderBy("doc_id", "size", "text_crc32"))
    out = dealt.withColumn("number", number).join(F.broadcast(starts), ["item", "salt"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
