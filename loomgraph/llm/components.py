"""Connected components of an edge table by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Labels that may be broadcast (16 bytes each); more are joined by shuffles.
BROADCAST_LABELS = 300_000
#: Rows of a table of edges or labels that one task takes at least.
ROWS = 50_000


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``, both long): label is the least node that can be reached.

    Each round takes the least label among neighbours and then jumps to the label's own label, so that a path of n edges
    needs some log n rounds. Every round is a written table: lineage stays short and lost executors cost a round at most.
    No edges: no rows.
    """
    apart = edges.where("a <> b").select("a", "b")
    many = max(1, edges.count() // ROWS)
    both = written(apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(many), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")).coalesce(many), "labels")
    small = labels.count() <= BROADCAST_LABELS
    sent = F.broadcast if small else lambda df: df
    while True:
        near = both.join(sent(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")).coalesce(many)
        met = near.join(sent(labels), "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = written(met.join(sent(jump), "to").select("node", F.least("to", "further").alias("label"), "was"), "labels")
        moved = new.where("label <> was").limit(1).count()
        forget(labels)
        path, labels = new.scratch_path, new.drop("was")
        labels.scratch_path = path
        if not moved:
            forget(both)
            return labels
