"""Embeddings of tables, and nearest vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import LOCAL_DIM, STOP_WORDS
from ..operators.vector_index import Best, slices
from ..shipping import ship

#: Query vectors that go to all tasks at once; more are worked on in blocks.
QUERIES = 2_000


#: Bytes of a text whose tokens are held at once, tokens whose buckets a task keeps, and bytes of such a token.
PIECE, KEPT, SHORT = 1 << 20, 1 << 20, 64
_WORD, _GAP = re.compile(rb"[a-z0-9_]+"), re.compile(rb"[^a-z0-9_]")


class _Buckets(dict):
    """The bucket of each token, ``dim`` for what is no token."""

    def __init__(self, dim: int) -> None:
        self.dim, self.left_out = dim, {w.encode() for w in STOP_WORDS}

    def __missing__(self, word: bytes) -> int:
        out = self.dim if len(word) < 2 or word in self.left_out else int.from_bytes(hashlib.md5(word).digest()[:8], "big") % self.dim
        if len(word) <= SHORT:
            self[word] = out
        return out

    def counts(self, text: bytes) -> np.ndarray:
        """How many tokens of a lower-cased text fall into each bucket; long texts are cut between tokens."""
        out, start = np.zeros(self.dim + 1, np.int64), 0
        while start < len(text):
            gap = _GAP.search(text, start + PIECE)
            end = gap.start() if gap else len(text)
            found = [self[w] for w in _WORD.findall(text, start, end)]
            out += np.bincount(np.array(found, np.int64), minlength=self.dim + 1)
            start = end
            if len(self) > KEPT:
                self.clear()
        return out[: self.dim]


def bucket_counts(df: DataFrame, key: str, text: str, dim: int = LOCAL_DIM) -> DataFrame:
    """``key, bucket, n``: how many tokens of each text fall into each bucket. A text's tokens are counted in the task that reads it."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(dim)
        for batch in (some for whole in batches for some in slices(whole, dim)):
            n = np.stack([known.counts(t) for t in batch.column(1).to_pylist()])
            row, bucket = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(n[row, bucket])], [key, "bucket", "n"])

    schema = T.StructType([df.schema[key], T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    counts = df.select(key, F.lower(text).cast("binary").alias("text")).where("text is not null").mapInArrow(run, schema)
    # counts are added up where a key repeats; by tasks of their own, as before the shuffle there is hardly anything to add
    return counts.repartition(key).groupBy(key, "bucket").agg(F.sum("n").alias("n"))


def embed(df: DataFrame, key: str, text: str, dim: int = LOCAL_DIM) -> DataFrame:
    """``key, vector``: bucket counts of unit length; null vectors, all zero, for texts without tokens."""
    counts = bucket_counts(df, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i) / F.col("norm"), F.lit(0.0)))
    return df.select(key).join(counts.select(key, dense.alias("vector")), key, "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)))


def nearest_vectors(queries: DataFrame, table: DataFrame, k: int, key: str = "id", vector: str = "vector", query: str = "query_id") -> DataFrame:
    """``query, key, similarity, rank`` of the k rows of ``table`` most similar, by cosine, to every row of ``queries`` (query, vector); ties by key.

    Queries are a stated set and go to all tasks in blocks of ``QUERIES``; each task keeps its own k best, slice by slice,
    before anything is shuffled. Null and all-zero vectors have similarity 0.
    """
    ship(table.sparkSession)
    rows = [(r[0], r[1]) for r in queries.select(query, vector).where(F.col(vector).isNotNull()).orderBy(query).collect()]
    ids = {query: queries.schema[query].dataType, key: table.schema[key].dataType}
    schema = f"{query} {ids[query].simpleString()}, {key} {ids[key].simpleString()}, similarity double"
    kinds = [to_arrow_type(ids[query]), to_arrow_type(ids[key])]
    out = None
    for i in range(0, max(1, len(rows)), QUERIES):
        block = rows[i : i + QUERIES]
        names = [r[0] for r in block]
        q = np.array([r[1] for r in block], float).reshape(len(block), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], names=names, q=q) -> Iterator[pa.RecordBatch]:
            best = Best(len(names), k)
            for batch in (some for whole in batches for some in slices(whole, max(q.shape))):
                if not len(names):
                    continue
                t = np.stack([np.asarray(v if v is not None else np.zeros(q.shape[1]), float) for v in batch.column(1).to_pylist()])
                t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300)
                best.take(np.arange(len(names)), q @ t.T, np.array(batch.column(0).to_pylist()))
            who, own, _, s = best.rows()
            yield pa.RecordBatch.from_pydict({query: pa.array([names[i] for i in who], kinds[0]), key: pa.array(own.tolist(), kinds[1]), "similarity": pa.array(s)})

        found = table.select(key, vector).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy(query).orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
