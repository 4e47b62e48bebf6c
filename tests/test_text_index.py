"""Searches by postings against scans of all texts."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import search, text_index
from loomgraph.sources.staging import fresh


def rows_of(df):
    return [tuple(r) for r in df.select("seq", "hits").collect()]


@pytest.fixture(scope="module")
def units(spark, sf):
    odd = [("äöÜ 😀😀x end", 400_000), ("ab", 400_001), ("", 400_002), (None, 400_003), ("[file: a/b.py] aaaa AAAA aaaaa", 5_000_000), ("thé " * 30_000, 70_000)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ending = F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".py")
    texts = docs.select(F.concat(F.lit("[file: a/"), "doc_id", ending, F.lit("]\n"), "text").alias("text"), F.col("doc_id").alias("seq"))
    return texts.unionByName(spark.createDataFrame(odd, "text string, seq long")).repartition(3)


@pytest.fixture(scope="module")
def index(spark, units):
    path = fresh(spark, "postings")
    text_index.write(units, path)
    return text_index.Index(spark, path)


TERMS = ["the", " THE ", "tion", "thention", "ung", "a", "ab", "", "aaa", "aaaa", "é", "äöü", "😀x", "😀😀", "no such words", "zqx", "a/1", "].", "\n", "%", "thé thé"]


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_a_scan(units, index, term):
    for by_index, scan in ((index.search_source, search.search_source), (index.search_documentation, search.search_documentation)):
        assert rows_of(by_index(term, 1000)) == rows_of(scan(units, term, 1000))


def test_more_candidates_than_a_filter_names(units, index, monkeypatch):
    monkeypatch.setattr(text_index, "FEW", 3)
    for term in ("the", "tion", "😀x"):
        assert rows_of(index.search_source(term, 1000)) == rows_of(search.search_source(units, term, 1000))


def test_small_blocks_give_the_same(spark, units, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 16)
    monkeypatch.setattr(text_index, "SPAN", 2)
    path = fresh(spark, "postings")
    text_index.write(units, path)
    small = text_index.Index(spark, path)
    assert small.postings.agg(F.max("n")).first()[0] <= 16
    for term in ("the", "ung", "aaaa"):
        assert rows_of(small.search_source(term, 1000)) == rows_of(search.search_source(units, term, 1000))


def test_a_search_reads_postings_and_few_units(spark, index):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = index.search_source("thention")._jdf.queryExecution().executedPlan().toString()
        lists = index.candidates("thention")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("FileScan parquet") == 1 and "folder#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "seq" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "bucket#" in lists.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in lists and "text" not in lists.split("ReadSchema")[1]


def test_an_empty_table_has_no_hits(spark, units):
    path = fresh(spark, "postings")
    text_index.write(units.limit(0), path)
    assert text_index.Index(spark, path).search_source("the").collect() == []
