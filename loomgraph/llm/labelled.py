"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo by."""
    return F.crc32(key.cast("string").cast("binary")) % by


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``most`` labelled texts of each class, chosen by the hash of their doc_id, without repeated texts; and each class's number of labels.

    ``usable`` is a condition on doc_id. Rows without a label or with any but 0 and 1 are left out, and so are doc_ids
    with both labels; a doc_id labelled several times counts once; a null text is empty. The ids of the chosen rows,
    2 * most at most, are broadcast to find their texts.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(usable & F.col("label").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    ids = chosen[0].union(chosen[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the same text many times over would count as many times as evidence
    once = Window.partitionBy("digest").orderBy("doc_id", "label")
    got = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").withColumn("digest", F.xxhash64("text"))
    got = got.withColumn("n", F.row_number().over(once)).where("n = 1").orderBy("doc_id").select("text", "label")
    return [(r["text"], r["label"]) for r in got.collect()], counts
