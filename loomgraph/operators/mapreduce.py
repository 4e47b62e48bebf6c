"""Global search over reports as a map and a reduce: reports are packed into batches, a model makes rated points of each batch, and the best points are put together.

All relevant reports count. They are dealt into parts by their number and packed within each part, in the order of their
relevance, so that no task sees them all; a batch has the reports that begin within ``BUDGET`` characters. The model runs
where the batches are, each prompt in one call. Points of equal text are merged, with their highest rating and the number
of reports behind them, before those that fit the reduce's budget are taken from the top.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Characters of a batch and of the points that are put together.
BUDGET, ANSWER = 12_000, 8_000
#: Batches that a part of the reports is meant to have.
BATCHES = 32

#: From a question and the text of a report, its points and their ratings from 0 to 100.
Rater = Callable[[str, str], list[tuple[str, float]]]


def terms(question: str) -> list[str]:
    """The words of a question, lower-cased, those of fewer than three letters left out."""
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in question.lower()).split() if len(w) > 2})


def rating(question: str, content: Column) -> Column:
    """The offline model's rating: the share of the question's words that a text holds, of 100."""
    words = terms(question)
    low = F.lower(content)
    hits = [F.contains(low, F.lit(w)).cast("int") for w in words]
    return F.lit(0.0) if not hits else F.round(100.0 * sum(hits[1:], hits[0]) / len(words), 2)


def packed(reports: DataFrame, question: str, budget: int = BUDGET, parts: int | None = None) -> DataFrame:
    """``part, batch`` and the columns of ``reports`` (seq, title, content) that are relevant, with ``relevance``."""
    found = reports.withColumn("relevance", rating(question, F.col("content"))).where("relevance > 0")
    if parts is None:
        total = found.agg(F.sum(F.least(F.length("content"), F.lit(budget)))).first()[0] or 0
        parts = max(1, total // (budget * BATCHES))
    before = Window.partitionBy("part").orderBy(F.desc("relevance"), "seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.least(F.length("content"), F.lit(budget))).over(before), F.lit(0))
    return found.withColumn("part", F.pmod("seq", F.lit(parts)).cast("int")).withColumn("batch", F.floor(used / budget).cast("int"))


def points(batches: DataFrame, question: str, rater: Rater | None = None, budget: int = BUDGET) -> DataFrame:
    """``part, batch, point, rating, seq`` of every report of :func:`packed`; offline, the title is the one point and its relevance the rating."""
    if rater is None:
        return batches.select("part", "batch", F.col("title").alias("point"), F.col("relevance").alias("rating"), "seq")
    ship(batches.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, b, point, float(rate), s) for p, b, s, text in zip(frame["part"], frame["batch"], frame["seq"], frame["content"]) for point, rate in rater(question, text)]
            yield pd.DataFrame(rows, columns=["part", "batch", "point", "rating", "seq"])

    return batches.select("part", "batch", "seq", F.left("content", F.lit(budget)).alias("content")).mapInPandas(run, "part int, batch int, point string, rating double, seq long")


def reduced(made: DataFrame, budget: int = ANSWER) -> DataFrame:
    """``place, point, rating, reports`` of the merged points with a rating, the highest first, that fit the budget one after the other."""
    merged = made.where("rating > 0 and length(point) > 0").groupBy("point").agg(F.max("rating").alias("rating"), F.count_distinct("seq").alias("reports"))
    order = [F.desc("rating"), F.desc("reports"), "point"]
    # every point has a character and a line end: no more than half the budget of them can fit
    top = merged.orderBy(*order).limit(budget // 2)
    line = Window.orderBy(*order)
    used = F.sum(F.length("point") + 1).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("place", F.row_number().over(line)).withColumn("used", used).where(F.col("used") <= budget).select("place", "point", "rating", "reports")
