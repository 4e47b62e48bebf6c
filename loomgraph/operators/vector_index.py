"""An inverted file of vectors with product-quantised residuals, written as Parquet and searched by cells.

Vectors of unit length are assigned to the nearest of some centroids; what is left of each is coded by a codebook for each
of several groups of dimensions, a byte each. The index is a table partitioned by cell: key, codes and the vector itself.
A search probes the cells nearest to a query, reads their codes only, keeps the best by the codes, and ranks those
anew by their vectors, for which no other cell is read. The exact way takes the k-th best of that search as a
bound: by the triangle inequality, a cell can hold nothing better if its centroid is farther than that plus its radius.

How many cells a search probes and how many candidates it ranks anew is set by the sample: the least that finds ``AIM`` of
the neighbours of ``TRIED`` of its vectors there. Clustered vectors need few cells, evenly spread ones many.

Centroids and codebooks are fitted on a sample of at most ``SAMPLE`` vectors and ``VALUES`` numbers, those with the smallest
hashes of their keys; every row is indexed. Null and all-zero vectors have no direction: they are kept in cell -1, have
similarity 0, and are found by the exact way alone. Vectors must be of one length. Queries are a stated set that goes to
the tasks in blocks of ``QUERIES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine
from ..shipping import ship

#: Vectors, and numbers in them, that the model is fitted on at most.
SAMPLE, VALUES = 20_000, 8_000_000
#: Centroids at most, rounds of fitting, codes of a codebook, groups of dimensions.
MOST_CELLS, ROUNDS, CODES, GROUPS = 4096, 12, 256, 8
#: Query vectors that go to all tasks at once.
QUERIES = 1_000
#: Vectors of the sample that the search is set by, neighbours of each, and the share of them that it has to find there.
TRIED, NEIGHBOURS, AIM = 200, 10, 0.96
#: Shares of the cells that are tried, and candidates for each result that is asked for.
SHARES, AGAIN = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0), (20, 50, 100)
#: Numbers of a matrix of scores, at most: rows are worked on in slices.
NUMBERS = 1 << 21
#: Cell of vectors without a direction.
NOWHERE = -1


def unit(rows: list, dim: int) -> np.ndarray:
    """A matrix of vectors of length 1; null and zero ones stay zero."""
    m = np.array([np.zeros(dim) if r is None else np.asarray(r, float) for r in rows], float).reshape(len(rows), dim)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - (centres * centres).sum(1) / 2, 1)


def clustered(points: np.ndarray, many: int, seed: int = 11) -> np.ndarray:
    """Centres of at most ``many`` clusters, by k-means from a spread start; an empty cluster takes the farthest point."""
    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T[::-1])] if len(points) else points
    centres = points[[rng.integers(len(points))]]
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < many and far.sum() > 1e-12:
        new = points[[rng.choice(len(points), p=far / far.sum())]]
        centres = np.concatenate([centres, new])
        far = np.minimum(far, ((points - new) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        empty = np.flatnonzero(n == 0)
        centres = total / np.maximum(n, 1)[:, None]
        if len(empty):
            centres[empty] = points[np.argsort(-((points - centres[own]) ** 2).sum(1), kind="stable")[: len(empty)]]
    return centres


def slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices, for each of which a matrix with ``width`` numbers a row stays within ``NUMBERS``."""
    step = max(1, NUMBERS // max(1, width))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


class Best:
    """The best rows so far of each of some queries: what a task holds, and what it gives, does not grow with its rows."""

    def __init__(self, many: int, k: int) -> None:
        self.k, self.score, self.cell, self.key = k, np.full((many, k), -np.inf), np.zeros((many, k), int), None

    def take(self, who: np.ndarray, score: np.ndarray, own: np.ndarray, cell: int = 0, exact: bool = True) -> None:
        """Scores of the rows ``own``, at least one, for the queries ``who``; ties to the smallest key if ``exact``."""
        own = own.astype(object) if own.dtype.kind in "US" else own
        if self.key is None:
            self.key = np.full(self.score.shape, own[0], own.dtype)
        some = (score >= self.score[who].min(1, keepdims=True)).any(1)
        who, score = who[some], score[some]
        if exact:
            order = np.argsort(own, kind="stable")
            top = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, : self.k]]
            score, own = np.take_along_axis(score, top, 1), own[top]
        score = np.concatenate([self.score[who], score], 1)
        own = np.concatenate([self.key[who], np.broadcast_to(own, (len(who), own.shape[-1]))], 1)
        cells = np.concatenate([self.cell[who], np.full((len(who), own.shape[1] - self.k), cell)], 1)
        if exact:
            order = np.argsort(own, axis=1, kind="stable")
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(score, order, 1), axis=1, kind="stable"), 1)[:, : self.k]
        else:
            order = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
        self.score[who], self.key[who], self.cell[who] = (np.take_along_axis(x, order, 1) for x in (score, own, cells))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries, keys, cells and scores."""
        q, i = np.nonzero(np.isfinite(self.score))
        return q, self.key[q, i] if self.key is not None else q, self.cell[q, i], self.score[q, i]


@dataclass
class Model:
    """centres: of each cell. books: of each group of dimensions, the codes' vectors. radius: of each cell, how far its vectors lie at most.

    probes: cells that a search looks into. again: candidates that it ranks anew, for each result that is asked for.
    """

    centres: np.ndarray
    books: list[np.ndarray]
    radius: np.ndarray | None = None
    probes: int = 1
    again: int = AGAIN[0]

    @property
    def cuts(self) -> list[slice]:
        width = np.cumsum([0] + [b.shape[1] for b in self.books])
        return [slice(a, b) for a, b in zip(width[:-1].tolist(), width[1:].tolist())]

    def coded(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of vectors of length 1: cells, codes, and distances from the cells' centres."""
        cell = nearest(points, self.centres)
        rest = points - self.centres[cell]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)
        return cell, codes, np.sqrt((rest * rest).sum(1))

    def set_by(self, points: np.ndarray) -> None:
        """Set probes and again: the fewest cells, then candidates, that find ``AIM`` of the neighbours of some of the points."""
        some = points[:: max(1, len(points) // TRIED)]
        near = some @ points.T
        # each is its own nearest
        truth = np.argsort(-near, 1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        cell, codes, _ = self.coded(points)
        by_codes = (some @ self.centres.T)[:, cell] + sum((some[:, c] @ b.T)[:, codes[:, g]] for g, (c, b) in enumerate(zip(self.cuts, self.books)))
        place = np.argsort(np.argsort(-(some @ self.centres.T - (self.centres**2).sum(1) / 2), 1, kind="stable"), 1)
        for share in SHARES:
            self.probes = max(1, round(share * len(self.centres)))
            inside = np.where(place[:, cell] < self.probes, by_codes, -np.inf)
            for self.again in AGAIN:
                top = np.argpartition(-inside, min(NEIGHBOURS * self.again, inside.shape[1]) - 1, 1)[:, : NEIGHBOURS * self.again]
                found = np.take_along_axis(np.isfinite(inside), truth, 1) & (truth[:, :, None] == top[:, None, :]).any(2)
                if found.mean() >= AIM:
                    return


def fitted(table: DataFrame, key: str, vector: str, cells: int | None = None, groups: int = GROUPS) -> Model:
    some = table.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    first = some.select(F.size(vector)).first()
    dim = first[0] if first else 1
    rows = [r[0] for r in some.select(vector, F.xxhash64(key).alias("_h"), key).orderBy("_h", key).limit(max(1, min(SAMPLE, VALUES // dim))).select(vector).collect()]
    points = unit(rows, dim) if rows else np.zeros((1, dim))
    many = cells or int(min(MOST_CELLS, max(1, round(table.count() ** 0.5)), max(1, len(points) // 8)))
    centres = clustered(points, many)
    rest = points - centres[nearest(points, centres)]
    model = Model(centres, [clustered(part, CODES) for part in np.array_split(rest, min(groups, dim), axis=1)])
    model.set_by(points)
    return model


def write(table: DataFrame, key: str, vector: str, path: str, cells: int | None = None, groups: int = GROUPS) -> None:
    """Index every row of ``table`` (key, vector) below ``path``. A cell that holds many rows is split among tasks and files."""
    spark = table.sparkSession
    ship(spark)
    model = fitted(table, key, vector, cells, groups)
    dim = model.centres.shape[1]
    sent = spark.sparkContext.broadcast(model)
    kind = table.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, max(dim, len(sent.value.centres), CODES))):
            points = unit(batch.column(1).to_pylist(), dim)
            cell, codes, far = sent.value.coded(points)
            cell = np.where(points.any(1), cell, NOWHERE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far)], ["key", "vector", "cell", "codes", "far"])

    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).mapInArrow(run, f"key {kind.simpleString()}, vector array<float>, cell int, codes binary, far double")
    rows.hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    radius = {r["cell"]: r["far"] for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("far").alias("far")).collect()} if table.limit(1).count() else {}
    listed = [("centre", i, 0, c.tolist(), radius.get(i, -1.0)) for i, c in enumerate(model.centres)]
    listed += [("code", i, g, c.tolist(), None) for g, b in enumerate(model.books) for i, c in enumerate(b)]
    listed.append(("search", model.probes, model.again, [], None))
    listed.append((f"key {kind.simpleString()}", 0, 0, [], None))
    spark.createDataFrame(listed, "part string, i int, grp int, vector array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


class Index:
    def __init__(self, spark: SparkSession, path: str) -> None:
        ship(spark)
        self.spark = spark
        rows = spark.read.parquet(f"{path}/model").orderBy("part", "grp", "i").collect()
        centres = [r for r in rows if r["part"] == "centre"]
        codes = [r for r in rows if r["part"] == "code"]
        books = [np.array([r["vector"] for r in codes if r["grp"] == g]) for g in range(1 + max(r["grp"] for r in codes))]
        (how,) = [r for r in rows if r["part"] == "search"]
        self.model = Model(np.array([r["vector"] for r in centres]), books, np.array([r["radius"] for r in centres]), how["i"], how["grp"])
        (key,) = [r["part"] for r in rows if r["part"].startswith("key ")]
        #: No vector with a direction was indexed, so that their length is not known.
        self.blank = bool((self.model.radius < 0).all())
        # an empty table has no file that would tell its columns
        self.rows = spark.read.schema(f"{key}, vector array<float>, codes binary, far double, cell int").parquet(f"{path}/rows")

    def _blocks(self, queries: DataFrame, query: str, vector: str) -> Iterator[tuple[list, np.ndarray, list]]:
        rows = [(r[0], r[1]) for r in queries.select(query, vector).where(F.col(vector).isNotNull()).orderBy(query).collect()]
        for i in range(0, max(1, len(rows)), QUERIES):
            block = rows[i : i + QUERIES]
            dim = len(block[0][1]) if block and self.blank else self.model.centres.shape[1]
            yield [r[0] for r in block], unit([r[1] for r in block], dim), [r[1] for r in block]

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query: str = "query_id", vector: str = "embedding") -> DataFrame:
        """``query, key, similarity, rank`` of about the k nearest rows of every query; ties by key. ``probes``: cells that are looked into, if not as many as the index was set to."""
        if self.blank:
            kind, stored = queries.schema[query].dataType.simpleString(), self.rows.schema["key"].dataType.simpleString()
            return self.spark.createDataFrame([], f"{query} {kind}, key {stored}, similarity double, rank int")
        cells = len(self.model.centres)
        probes = min(cells, probes or self.model.probes)
        out = None
        for names, q, given in self._blocks(queries, query, vector):
            at = np.argsort(-(q @ self.model.centres.T - (self.model.centres**2).sum(1) / 2), 1, kind="stable")[:, :probes]
            found = self._ranked(self._candidates(names, q, at, k * self.model.again, queries.schema[query].dataType), names, given, queries, query, k)
            out = found if out is None else out.unionByName(found)
        return out

    def _candidates(self, names: list, q: np.ndarray, at: np.ndarray, most: int, kind) -> DataFrame:
        """``q, cell, key``: of each query, the best by their codes."""
        model, asked = self.model, {int(c): np.flatnonzero((at == c).any(1)) for c in np.unique(at)}
        # the inner product of a query with each code of each group
        tables = [q[:, c] @ b.T for c, b in zip(model.cuts, model.books)]
        sent = self.spark.sparkContext.broadcast((asked, tables, q @ model.centres.T))
        stored = self.rows.schema["key"].dataType
        form = to_arrow_type(stored)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, tables, base = sent.value
            best = Best(len(base), most)
            for batch in (some for whole in batches for some in slices(whole, max(len(base), most))):
                cell, own = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
                for c in np.unique(cell).tolist():
                    rows, who = np.flatnonzero(cell == c), asked.get(c)
                    if who is None:
                        continue
                    score = base[who, c][:, None] + sum(t[who][:, codes[rows, g]] for g, t in enumerate(tables))
                    best.take(who, score, own[rows], c, exact=False)
            who, own, cell, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(cell, pa.int32()), pa.array(own.tolist(), form), pa.array(score)], ["q", "cell", "key", "score"])

        read = self.rows.where(F.col("cell").isin([int(c) for c in asked])).select("cell", "key", "codes")
        found = read.mapInArrow(run, f"q int, cell int, key {stored.simpleString()}, score double")
        best = Window.partitionBy("q").orderBy(F.desc("score"), "key")
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("q", "cell", "key")

    def _ranked(self, candidates: DataFrame, names: list, given: list, queries: DataFrame, query: str, k: int) -> DataFrame:
        """Candidates by their own vectors. A block has QUERIES * AGAIN[-1] * k of them at most, which are broadcast."""
        kind = queries.schema[query].dataType.simpleString()
        asked = self.spark.createDataFrame([(i, n, [float(x) for x in g]) for i, (n, g) in enumerate(zip(names, given))], f"q int, {query} {kind}, asked array<double>")
        both = self.rows.select("cell", "key", "vector").join(F.broadcast(candidates), ["cell", "key"]).join(F.broadcast(asked), "q")
        scored = both.select(query, "key", cosine(F.col("vector"), F.col("asked")).alias("similarity"))
        order = Window.partitionBy(query).orderBy(F.desc("similarity"), "key")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def exact(self, queries: DataFrame, k: int, query: str = "query_id", vector: str = "embedding") -> DataFrame:
        """``query, key, similarity, rank`` of the k nearest rows of every query, no other; ties by key."""
        model, out = self.model, None
        stored, kind = self.rows.schema["key"].dataType, queries.schema[query].dataType
        bound: dict = {}
        for r in self.search(queries, k, query=query, vector=vector).where(F.col("rank") == k).collect():
            bound[r[query]] = r["similarity"]
        for names, q, _ in self._blocks(queries, query, vector):
            known = np.array([bound.get(n, -1.0) for n in names])
            apart = np.zeros((len(names), len(model.centres)))
            if len(names) and not self.blank:
                apart = np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + (model.centres**2).sum(1) - 2 * q @ model.centres.T))
            reach = np.sqrt(np.maximum(0.0, 2 - 2 * known))[:, None] + 1e-6
            need = (apart - model.radius[None] <= reach) & (model.radius[None] >= 0)
            need = need | ~q.any(1)[:, None]
            asked = {c: np.flatnonzero(need[:, c]) for c in np.flatnonzero(need.any(0)).tolist()}
            # nothing without a direction can be among the best if those are better than 0
            loose = np.flatnonzero(known <= 1e-6)
            if len(loose):
                asked[NOWHERE] = loose
            sent = self.spark.sparkContext.broadcast((asked, q))
            kinds = [to_arrow_type(kind), to_arrow_type(stored)]

            def run(batches: Iterator[pa.RecordBatch], names=names, sent=sent, kinds=kinds) -> Iterator[pa.RecordBatch]:
                asked, q = sent.value
                best = Best(len(names), k)
                for batch in (some for whole in batches for some in slices(whole, max(q.shape))):
                    cell, own = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
                    points = unit(batch.column(2).to_pylist(), q.shape[1])
                    for c in np.unique(cell).tolist():
                        rows, who = np.flatnonzero(cell == c), asked.get(c)
                        if who is not None:
                            best.take(who, q[who] @ points[rows].T, own[rows])
                who, own, _, s = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in who], kinds[0]), pa.array(own.tolist(), kinds[1]), pa.array(s)], [query, "key", "similarity"])

            read = self.rows.where(F.col("cell").isin(list(asked))).select("cell", "key", "vector")
            found = read.mapInArrow(run, f"{query} {kind.simpleString()}, key {stored.simpleString()}, similarity double")
            out = found if out is None else out.unionByName(found)
        order = Window.partitionBy(query).orderBy(F.desc("similarity"), "key")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, query: str = "query_id") -> float:
    """The share of the rows (query, key) of ``truth`` that are among those found."""
    both = truth.select(query, "key").join(found.select(query, "key").withColumn("hit", F.lit(1)), [query, "key"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
