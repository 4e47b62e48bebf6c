"""A training corpus in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. Documents that the toxicity classifier rejects go; blocks of lines
that an earlier document has are deleted; one document of each group of near-duplicates stays; documents that hold a
benchmark item go; what is left is encoded and decoded.

Defined cases, in every stage: a null text is treated as an empty one and stays null up to the last stage, which gives it
no tokens; rows without a doc_id are scored, searched and encoded, but are neither copies of others nor the copied; rows
of one doc_id are no copies of one another, and near dedup keeps or drops them together; of copies the one with the
smallest doc_id stays; a text that loses all its lines stays as an empty one; without usable labels nothing is toxic, and
without usable items nothing is contaminated; an empty table gives no rows; extra columns, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from loomgraph.llm.common import read, written
from loomgraph.llm.queries import ranks_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels of these documents, does not reject."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without blocks of lines that an earlier one has; n_chars follows the text."""
    names = docs.columns
    out = line_dedup.deduplicated(docs)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        removed = line_dedup.report_names(names)[0]
        out = out.withColumn("n_chars", F.when(F.col(f"`{removed}`") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{n}`") for n in names])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; rows without doc_id stay."""
    return near_dedup.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document, doc_id, the number of tokens, and digests of ids and decoded bytes."""
    return bpe.round_trip(docs, ranks_path(), limits=bpe.SMALL)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("byte-level bpe", encode_and_decode),
]

#: No SQL: the stages fit a classifier, align lines and run an automaton; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a written table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
