"""A posting index of trigrams over text units, written as Parquet, and text search that reads postings and matched texts.

The index holds, for each trigram of the lower-cased texts, the numbers of the units that have it. Numbers are ``seq``, cut into
blocks of ``BLOCK``: a row is one trigram's sorted places in one block, or in a part of it, so that no list grows with the
table. Tasks make lists of some ``LETTERS`` at a time, and only these are shuffled. Rows lie in ``BUCKETS`` folders by the trigram's hash, sorted by
trigram; lists are written with Parquet's delta encoding of integers. Beside them lie the units, in folders of blocks,
sorted by number.

A term's trigrams are looked up in the smallest columns first, for their numbers of units; the ``RAREST`` with the fewest
are read and intersected block by block. What is left are candidates: their texts are read, by number where they are
few, and the count is confirmed on each. Terms of fewer than three characters have no trigram and are looked for in all
texts.

``seq`` must be unique, not null and not negative; it should be dense, as sparse numbers make short lists. A null text holds
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import occurrences
from ..shipping import ship
from . import search

#: Unit numbers of a block, folders of trigrams, and blocks of a folder of units.
BLOCK, BUCKETS, SPAN = 1 << 16, 64, 16
#: Letters of the texts whose lists a task makes at once.
LETTERS = 1 << 22
#: Trigrams of a term that are intersected; a count on the texts does the rest.
RAREST = 4
#: Candidates that a filter names; more are joined, and up to ``SENT`` of them are sent to the units' tasks.
FEW, SENT = 2000, 1_000_000


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-cased text."""
    # as an array of characters, so that a long text takes time in step with its length
    each = F.split(F.lower(text), "")
    joined = lambda x, y: F.concat(x, y)
    three = F.zip_with(F.zip_with(each, F.slice(each, 2, F.size(each)), joined), F.slice(each, 3, F.size(each)), joined)
    return F.array_distinct(F.filter(three, lambda x: x.isNotNull()))


def _has_trigrams(text: Column) -> Column:
    return F.length(F.lower(text)) >= 3


def _slices(batches: Iterator[pa.RecordBatch], letters: int) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts of at most so many letters; of a longer text, parts that share two letters, each in a slice of its own."""
    numbers, texts, size = [], [], 0
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for i in range(0, max(1, len(text) - 2), letters):
                part = text[i : i + letters + 2]
                if texts and size + len(part) > letters:
                    yield numbers, texts
                    numbers, texts, size = [], [], 0
                numbers.append(number)
                texts.append(part)
                size += len(part)
    if texts:
        yield numbers, texts


def _lists(numbers: list[int], texts: list[str], block: int) -> pa.RecordBatch:
    """``gram, block, places`` of some units, by one sort of whole numbers that stand for a trigram and a unit."""
    seq = np.array(numbers, np.int64)
    order = np.argsort(seq)
    rank = np.empty(len(seq), np.int64)
    rank[order] = np.arange(len(seq))
    seq = seq[order]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    unit = np.repeat(rank, [len(t) for t in texts])
    # letters are numbered as they are found, so that three of them and a unit are one whole number, but for very many letters
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    letter, many = place[points], len(alphabet)
    whole = unit[:-2] == unit[2:]
    gram = ((letter[:-2] * many + letter[1:-1]) * many + letter[2:])[whole]
    unit, bits = unit[:-2][whole], max(1, int(len(seq) - 1).bit_length())
    names = None
    if many**3 >> (63 - bits):
        names, gram = np.unique(gram, return_inverse=True)
    key = (gram << bits) | unit
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    gram, own = key >> bits, seq[key & ((1 << bits) - 1)]
    blocks = own // block
    first = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0))
    gram = gram[first] if names is None else names[gram[first]]
    three = np.stack([alphabet[gram // many**2], alphabet[gram // many % many], alphabet[gram % many]], 1).astype("<u4").tobytes().decode("utf-32-le")
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(own % block, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([three[i : i + 3] for i in range(0, len(three), 3)], pa.string()), pa.array(blocks[first]), places], ["gram", "block", "places"])


def _postings(block: int, letters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: (_lists(numbers, texts, block) for numbers, texts in _slices(batches, letters))


def write(units: DataFrame, path: str) -> None:
    """Index ``units`` (text, seq and any other columns) below ``path``."""
    numbered = units.withColumn("block", F.floor(F.col("seq") / BLOCK).cast("long")).withColumn("folder", F.floor(F.col("seq") / (BLOCK * SPAN)).cast("long"))
    numbered.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/units")
    spark = units.sparkSession
    spark.createDataFrame([(numbered.schema.json(),)], "fields string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    stored = _units(spark, path)
    has = stored.where(_has_trigrams(F.col("text")))
    ship(spark)
    # a term is valid UTF-8, so that its trigrams are whatever stands for bytes that are not
    lists = has.select("seq", F.make_valid_utf8(F.lower("text"))).mapInArrow(_postings(BLOCK, LETTERS), "gram string, block long, places array<int>").withColumn("n", F.size("places"))
    lists = lists.withColumn("bucket", _bucket(F.col("gram"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "block")
    lists.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").partitionBy("bucket").parquet(f"{path}/postings")


def _units(spark: SparkSession, path: str) -> DataFrame:
    """The units; an empty table has no file that would tell its columns."""
    fields = spark.read.parquet(f"{path}/schema").first()["fields"]
    return spark.read.schema(T.StructType.fromJson(json.loads(fields))).parquet(f"{path}/units")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class Index:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.units = _units(spark, path)
        self.postings = spark.read.schema("gram string, block long, places array<int>, n int, bucket int").parquet(f"{path}/postings")

    def _grams(self, term: str) -> list[tuple[str, int]]:
        """Trigrams of a term as the index has them, with their folders."""
        one = self.spark.createDataFrame([(term,)], "term string").where(_has_trigrams(F.trim("term"))).select(F.explode(trigrams(F.trim("term"))).alias("gram"))
        return [(r["gram"], r["bucket"]) for r in one.withColumn("bucket", _bucket(F.col("gram"))).collect()]

    def read(self, grams: list[tuple[str, int]]) -> DataFrame:
        """The lists of some trigrams: their folders' files alone, and of those the row groups that can have them."""
        return self.postings.where(F.col("bucket").isin(sorted({b for _, b in grams})) & F.col("gram").isin([g for g, _ in grams]))

    def candidates(self, term: str) -> DataFrame | None:
        """``block, place`` of the units that have the rarest trigrams of a term; None where it has none."""
        grams = self._grams(term)
        if not grams:
            return None
        sizes = {r["gram"]: r["n"] for r in self.read(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):
            return self.postings.limit(0).select("block", F.lit(0).alias("place"))
        rare = sorted(grams, key=lambda g: (sizes[g[0]], g[0]))[:RAREST]
        own = [F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("places")))) for g, _ in rare]
        lists = self.read(rare).groupBy("block").agg(F.array(*own).alias("lists"))
        both = F.aggregate(F.slice("lists", 2, RAREST), F.array_distinct(F.element_at("lists", 1)), lambda a, b: F.array_intersect(a, b))
        return lists.select("block", F.explode(both).alias("place"))

    def matching(self, term: str) -> DataFrame:
        """Units that may hold the term: all that do, and hardly any other."""
        found = self.candidates(term)
        if found is None:
            return self.units.drop("block", "folder")
        few = [r["block"] * BLOCK + r["place"] for r in found.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            folders = sorted({n // (BLOCK * SPAN) for n in few})
            some = self.units.where(F.col("folder").isin(folders) & F.col("seq").isin(few)) if few else self.units.limit(0)
        else:
            found = found.select((F.col("block") * BLOCK + F.col("place")).alias("seq"))
            some = self.units.join(F.broadcast(found) if found.limit(SENT + 1).count() <= SENT else found, "seq", "left_semi")
        return some.drop("block", "folder")

    def holding(self, term: str) -> DataFrame:
        """The units that hold the term, with ``hits``, how often they do."""
        return self.matching(term).withColumn("hits", occurrences(F.col("text"), F.lit(term))).where("hits > 0")

    def search_source(self, term: str, limit: int = search.LIMIT) -> DataFrame:
        return search.search_source(self.matching(term), term, limit)

    def search_documentation(self, term: str, limit: int = search.LIMIT) -> DataFrame:
        return search.search_documentation(self.matching(term), term, limit)

    def find_relations(self, term: str, kind: str | None = None, limit: int = search.LIMIT) -> DataFrame:
        """As the search of relations, where the index is of :func:`relation_texts`: a relation is found by any of its three texts."""
        return search.find_relations(self.matching(term), term, kind, limit)


def relation_texts(relations: DataFrame) -> DataFrame:
    """Relations with ``text``, which holds whatever source, target or description hold."""
    return relations.withColumn("text", F.concat_ws("\n", "source", "target", "description"))
