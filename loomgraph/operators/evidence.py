"""Evidence for an answer: deduplication, a budget and a summary; and repeated tool calls."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import evidence_key

#: Characters of rendered evidence.
BUDGET = 24_000
#: A block that overflows is cut to what is left but for SPARE characters, if that is more than LEAST.
SPARE, LEAST, CUT = 60, 200, "\n... [truncated]"


def deduplicate(evidence: DataFrame) -> DataFrame:
    """The first, by seq, of all evidence with one key."""
    key = evidence_key(F.col("kind"), F.col("title"), F.col("content"))
    return evidence.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*evidence.columns), "seq").alias("_first")).select("_first.*")


def blocks(evidence: DataFrame):
    loc = F.when(F.coalesce("loc", F.lit("")) != "", F.concat(F.lit(" ("), "loc", F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), "source", F.lit(" | "), "kind", F.lit(" | "), "title", F.lit("]"), loc, F.lit("\n"), "content")


def within_budget(evidence: DataFrame, budget: int = BUDGET, by: list[str] | None = None) -> DataFrame:
    """What fits the budget, heaviest first, with ``block`` and ``place``; each block costs two characters more.

    The first block that overflows is cut to what is left, if that is worth it, and nothing follows it. ``by`` names the
    columns of separate budgets; without it there is one, and evidence is then that of one question.
    """
    by = by or []
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "seq")
    sized = evidence.withColumn("block", blocks(evidence)).withColumn("_cost", F.length("block") + 2)
    ran = sized.withColumn("_used", F.sum("_cost").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_used", F.coalesce("_used", F.lit(0)))
    ran = ran.withColumn("place", F.row_number().over(order)).withColumn("_over", F.col("_used") + F.length("block") > budget)
    ran = ran.withColumn("_overs", F.sum(F.col("_over").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.lit(budget - SPARE) - F.col("_used")
    fits = (F.col("_overs") == 0) | (F.col("_over") & (F.col("_overs") == 1) & (room > LEAST))
    cut = F.when(F.col("_over"), F.concat(F.left("block", room.cast("int")), F.lit(CUT))).otherwise(F.col("block"))
    return ran.where(fits).withColumn("block", cut).drop("_cost", "_used", "_over", "_overs")


def summary(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("source").agg(F.count("*").alias("n"))


def repeated_calls(calls: DataFrame, signature: list[str]) -> DataFrame:
    """``calls`` with ``repeated``: whether one of the same signature came before, by seq."""
    first = calls.groupBy(*[F.col(c).alias(f"_{c}") for c in signature]).agg(F.min("seq").alias("_first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in signature])
    return calls.join(first, same).withColumn("repeated", F.col("seq") > F.col("_first")).select(*calls.columns, "repeated")
