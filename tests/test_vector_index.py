"""The vector index against brute force over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import vector_index
from loomgraph.sources.staging import fresh

SCHEMA = "id long, v array<float>"


def clouds(seed, n=3000, dim=24, many=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(many, dim)) * 2
    return [(i, (centres[i % many] + rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    m = vector_index.unit([v for _, v in rows], len(queries[0][1]))
    out = {}
    for name, q in queries:
        s = m @ vector_index.unit([q], len(q))[0]
        order = np.lexsort((ids, -np.round(s, 9)))[:k]
        out[name] = [(int(ids[i]), round(float(s[i]), 5)) for i in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["key"], round(r["similarity"], 5)))
    return out


@pytest.fixture(scope="module")
def index(spark):
    rows = clouds(1)
    path = fresh(spark, "index")
    vector_index.write(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "v", path)
    return rows, vector_index.Index(spark, path)


def asked(spark, queries):
    return spark.createDataFrame(queries, "query_id long, embedding array<float>")


def test_recall_and_the_exact_way(spark, index, monkeypatch):
    rows, ix = index
    queries = [r for r in rows if r[0] % 100 == 0]
    truth = brute(rows, queries, 10)
    for block in (1000, 7):
        monkeypatch.setattr(vector_index, "QUERIES", block)
        assert got(ix.exact(asked(spark, queries), 10)) == truth
    flat = spark.createDataFrame([(q, k) for q, found in truth.items() for k, _ in found], "query_id long, key long")
    assert vector_index.recall(ix.search(asked(spark, queries), 10), flat) >= 0.9
    # a single cell finds less, all of them nearly everything
    assert vector_index.recall(ix.search(asked(spark, queries), 10, probes=len(ix.model.centres)), flat) >= 0.97


def test_every_row_is_indexed_and_a_search_reads_its_cells(spark, index):
    rows, ix = index
    assert ix.rows.count() == len(rows) and ix.rows.select("key").distinct().count() == len(rows)
    plan = ix._candidates([0], vector_index.unit([rows[0][1]], 24), np.array([[0, 3]]), 5, None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "[cell") or "cell#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "vector" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_far_queries_zero_vectors_ties_and_few_rows(spark):
    same = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100 + i, [0.0, 1.0, 0.0]) for i in range(5)] + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [-1.0, 0.0, 0.0])]
    path = fresh(spark, "index")
    vector_index.write(spark.createDataFrame(same, SCHEMA), "id", "v", path, cells=4)
    ix = vector_index.Index(spark, path)
    queries = [(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [0.0, 3.0, 0.1])]
    assert got(ix.exact(asked(spark, [*queries, (5, None)]), 7)) == brute(same, queries, 7)
    assert got(ix.exact(asked(spark, queries), 60)) == brute(same, queries, 60)
    none = fresh(spark, "index")
    vector_index.write(spark.createDataFrame([], SCHEMA), "id", "v", none)
    empty = vector_index.Index(spark, none)
    assert empty.search(asked(spark, queries), 7).collect() == [] and empty.exact(asked(spark, queries), 7).collect() == []


def test_one_cell_may_hold_most_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[0] + 1e-3 * rng.normal(size=8)).tolist()) for i in range(2000)] + [(5000 + i, rng.normal(size=8).tolist()) for i in range(200)]
    path = fresh(spark, "index")
    vector_index.write(spark.createDataFrame(rows, SCHEMA), "id", "v", path, groups=3)
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in rows]
    queries = [rows[0], rows[2100]]
    truth, found = brute(rows, queries, 5), got(vector_index.Index(spark, path).exact(asked(spark, queries), 5))
    assert {q: [s for _, s in x] for q, x in found.items()} == {q: [s for _, s in x] for q, x in truth.items()}
