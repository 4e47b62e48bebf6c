"""Finding entities and walking their relations.

Entities have id, name, qualified_name, type, file, seq; relations have source, target, type, seq. Each function gives a
DataFrame; none that has nothing to show fails.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import match_score
from ..sources.staging import fresh, staged

CODE = ["function", "method", "class"]
#: Matches that a symbol's location shows, files that are shown as related, keys and affected entities of a configuration.
TOP, FILES, KEYS, AFFECTED = 8, 15, 3, 10
#: Ids that a filter names.
FEW = 1000


def find_entity(entities: DataFrame, term: str, types: list[str] | None = None) -> DataFrame:
    """Entities that fit the term, with ``score``; the best are those of the highest score, then shortest qualified_name, then least seq."""
    some = entities.where(F.col("type").isin(types)) if types else entities
    return some.withColumn("score", match_score(F.col("name"), F.col("qualified_name"), F.lit(term))).where("score > 0")


def entity_by_file(entities: DataFrame, kind: str = "file") -> DataFrame:
    """``file`` and the first entity of a kind in it, by seq."""
    some = entities.where((F.col("type") == kind) & F.col("file").isNotNull())
    rest = [c for c in entities.columns if c != "file"]
    return some.groupBy("file").agg(F.min_by(F.struct(*rest), "seq").alias("e")).select("file", "e.*")


def _best_first() -> list:
    return [F.desc("score"), F.length("qualified_name"), "seq"]


def best(entities: DataFrame, term: str, types: list[str] | None = None, limit: int = 1) -> DataFrame:
    return find_entity(entities, term, types).orderBy(*_best_first()).limit(limit)


def where_is(entities: DataFrame, term: str, limit: int = TOP) -> DataFrame:
    """The best matches, code symbols and exact names first, with ``rank`` from 1 and a description of at most 200 characters."""
    t = F.lit(term.lower())
    weight = 4 * (F.lower("qualified_name") == t).cast("int") + 3 * (F.lower("name") == t).cast("int") + F.col("type").isin(CODE).cast("int")
    order = [F.desc("weight"), F.length("qualified_name"), F.desc("score"), "seq"]
    top = find_entity(entities, term).withColumn("weight", weight).orderBy(*order).limit(limit)
    # the window runs over limit rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("description", F.left("description", F.lit(200)))


def neighbours(relations: DataFrame, entities: DataFrame, of: DataFrame, kind: str | None = None, outgoing: bool = True) -> DataFrame:
    """The distinct entities that those of ``of`` (id) point to, or are pointed to by, with ``seq`` of the first relation as ``first``."""
    here, there = ("source", "target") if outgoing else ("target", "source")
    edges = relations.where(F.col("type") == kind) if kind else relations
    ends = touching(edges, here, of).groupBy(F.col(there).alias("id")).agg(F.min("seq").alias("first"))
    return entities.join(ends, "id")


def touching(edges: DataFrame, end: str, of: DataFrame) -> DataFrame:
    """The edges whose ``end`` is one of ``of`` (id): a literal list, which reaches the scan, of up to FEW ids, beyond that a semi-join."""
    ids = [r[0] for r in of.select("id").limit(FEW + 1).collect()]
    if len(ids) <= FEW:
        return edges.where(F.col(end).isin(ids))
    return edges.join(of.select(F.col("id").alias(end)).distinct(), end, "left_semi")


def callers(entities: DataFrame, relations: DataFrame, term: str, types=("function", "method", "class", "api")) -> DataFrame:
    return neighbours(relations, entities, best(entities, term, list(types)), "CALLS", outgoing=False)


def callees(entities: DataFrame, relations: DataFrame, term: str, types=("function", "method", "class")) -> DataFrame:
    return neighbours(relations, entities, best(entities, term, list(types)), "CALLS")


def _module(entities: DataFrame, term: str, types=("module", "file")) -> DataFrame:
    """Of the matches, modules before files, then by qualified_name."""
    rank = reduce(lambda c, i: c.when(F.col("type") == types[i], i), range(1, len(types)), F.when(F.col("type") == types[0], 0))
    return find_entity(entities, term, list(types)).orderBy(rank, "qualified_name", "seq").limit(1)


def imports_of(entities: DataFrame, relations: DataFrame, term: str, types=("module", "file"), kind: str = "IMPORTS") -> DataFrame:
    return neighbours(relations, entities, _module(entities, term, types), kind)


def imported_by(entities: DataFrame, relations: DataFrame, term: str, types=("module", "file"), kind: str = "IMPORTS") -> DataFrame:
    return neighbours(relations, entities, _module(entities, term, types), kind, outgoing=False)


def inherits(entities: DataFrame, relations: DataFrame, term: str, types=("class",), kind: str = "INHERITS") -> DataFrame:
    """What the best match points to (``direction`` "out") and what points to it ("in")."""
    one = best(entities, term, list(types))
    out, back = neighbours(relations, entities, one, kind), neighbours(relations, entities, one, kind, outgoing=False)
    return out.withColumn("direction", F.lit("out")).unionByName(back.withColumn("direction", F.lit("in")))


class Layer(NamedTuple):
    """What is reached in one hop: a table of ids, how many, and the ids themselves if they are at most ``FEW``."""

    rows: DataFrame
    many: int
    ids: list | None


class Paths:
    """Relations stored twice, in buckets by source and in buckets by target, for searches of shortest paths between two ends.

    A hop joins a frontier with the edges where they lie: the frontier alone is moved, or named in a filter if it is small.
    """

    def __init__(self, relations: DataFrame, buckets: int | None = None) -> None:
        self.spark = relations.sparkSession
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        edges = relations.select(F.col("source").alias("a"), F.col("target").alias("b"), "seq")
        self.names: list[str] = []
        self.out, self.into = self._stored(edges, "a"), self._stored(edges, "b")

    def _stored(self, edges: DataFrame, by: str) -> DataFrame:
        name = f"loomgraph_edges_{uuid.uuid4().hex}"
        edges.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).option("path", fresh(self.spark, "edges")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Forget the tables; their files go with the application's other scratch tables."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def __enter__(self) -> Paths:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _layer(self, found: DataFrame, small: bool) -> Layer:
        """What a hop has found: named if there are few ids, else a written table. small: that there may be few."""
        if small:
            ids = [r["id"] for r in found.limit(FEW + 1).collect()]
            if len(ids) <= FEW:
                return self._named(ids)
        table = staged(found, "reached")
        return Layer(table, table.count(), None)

    def _named(self, ids: list) -> Layer:
        kind = T.StructType([T.StructField("id", self.out.schema["a"].dataType)])
        return Layer(self.spark.createDataFrame([(x,) for x in ids], kind), len(ids), ids)

    def _from(self, front: Layer, forward: bool, directed: bool) -> DataFrame:
        """``a, b, seq``: the edges that lead from a frontier forward, or into it; b is the new end, a the frontier's."""

        def met(edges: DataFrame, here: str, there: str) -> DataFrame:
            some = edges.where(F.col(here).isin(front.ids)) if front.ids is not None else edges.join(front.rows.select(F.col("id").alias(here)), here, "left_semi")
            return some.select(F.col(here).alias("a"), F.col(there).alias("b"), "seq")

        ahead = met(self.out, "a", "b") if forward or not directed else None
        back = met(self.into, "b", "a") if not forward or not directed else None
        return ahead.unionByName(back) if ahead is not None and back is not None else ahead if ahead is not None else back

    def shortest(self, start, goal, most: int = 32, directed: bool = True) -> list:
        """The ids of a shortest path of at most ``most`` edges; empty if there is none. Of equal paths, each step back from the goal takes the earliest relation.

        Both ends are searched at once, a whole hop of the smaller frontier at a time, until the frontiers meet.
        """
        if start == goal:
            return [start]
        sides = [[self._named([start])], [self._named([goal])]]
        met = None
        while met is None and sum(len(s) - 1 for s in sides) < most:
            way = 0 if sides[0][-1].many <= sides[1][-1].many else 1
            front, other = sides[way][-1], sides[1 - way][-1]
            new = self._from(front, way == 0, directed).select(F.col("b").alias("id")).distinct()
            # of a layer's neighbours, only the layers next to it can hold what was reached before, if edges go both ways
            for layer in sides[way] if directed else sides[way][-2:]:
                new = new.where(~F.col("id").isin(layer.ids)) if layer.ids is not None else new.join(layer.rows, "id", "left_anti")
            found = self._layer(new, front.ids is not None)
            if not found.many:
                return []
            sides[way].append(found)
            # the frontiers meet for the first time in their last layers
            both = self._both(found, other)
            met = both if both.many else None
        return self._walked(sides[0], sides[1], met, directed) if met is not None else []

    def _both(self, a: Layer, b: Layer) -> Layer:
        if a.ids is not None and b.ids is not None:
            return self._named(sorted(set(a.ids) & set(b.ids)))
        return self._layer(a.rows.join(b.rows, "id", "left_semi"), True)

    def _walked(self, ahead: list[Layer], back: list[Layer], met: Layer, directed: bool) -> list:
        """The path through the layers of both sides, which meet in ``met``: for each layer, the edge from the one before it."""

        def next_to(layer: Layer, forward: bool, among: Layer) -> Layer:
            near = self._from(layer, forward, directed).select(F.col("b").alias("id")).distinct()
            return self._layer(near.where(F.col("id").isin(among.ids)) if among.ids is not None else near.join(among.rows, "id", "left_semi"), True)

        # towards the start, what leads to met; from there on, what met leads to
        layers = [met]
        for layer in reversed(ahead[:-1]):
            layers.insert(0, next_to(layers[0], False, layer))
        for layer in reversed(back[:-1]):
            layers.append(next_to(layers[-1], True, layer))
        path = layers[0].rows.select("id", F.array("id").alias("path"))
        for before, layer in zip(layers, layers[1:]):
            step = self._from(layer, False, directed).join(before.rows.select(F.col("id").alias("b")), "b", "left_semi")
            via = step.groupBy(F.col("a").alias("id")).agg(F.min_by("b", F.struct("seq", "b")).alias("via"))
            path = via.join(path.select(F.col("id").alias("via"), "path"), "via").select("id", F.concat("path", F.array("id")).alias("path"))
        return path.first()["path"]


def call_path(entities: DataFrame, relations: DataFrame, source: str, target: str, from_types=("function", "method", "api"), to_types=("function", "method", "class"), most: int = 32) -> DataFrame:
    """``step`` and the entity of each node on a shortest path between the best matches, over relations of all types.

    Directed if there is such a path, otherwise along edges either way. Of equal paths, each step back takes the earliest
    relation. Nothing is found: no rows.
    """
    spark = entities.sparkSession
    a, b = best(entities, source, list(from_types)).select("id").first(), best(entities, target, list(to_types)).select("id").first()
    ids: list = []
    if a and b:
        with Paths(relations) as paths:
            ids = paths.shortest(a["id"], b["id"], most) or paths.shortest(a["id"], b["id"], most, directed=False)
    kind = entities.schema["id"].dataType.simpleString()
    steps = spark.createDataFrame(list(enumerate(ids)), f"step int, id {kind}")
    # at most ``most`` + 1 rows
    return entities.join(F.broadcast(steps), "id")


def config_affects(entities: DataFrame, relations: DataFrame, key: str, kinds=("configuration", "constant"), link="CONFIGURED_BY", read="READS_CONFIG") -> DataFrame:
    """What the best matches of a configuration key affect: ``rank, id, how`` by link, by read and by any relation, each entity once.

    Configurations match as terms do; constants by equal names, underscores, hyphens and case aside.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "[_-]", ""))
    found = find_entity(entities, key, [kinds[0]]).orderBy(*_best_first()).limit(KEYS).select("id", F.lit(0).alias("part"), "score", F.length("qualified_name").alias("size"), "seq")
    same = entities.where((F.col("type") == kinds[1]) & (plain(F.col("name")) == plain(F.lit(key)))).orderBy("seq").limit(KEYS)
    keys = found.unionByName(same.select("id", F.lit(1).alias("part"), F.lit(0).alias("score"), F.lit(0).alias("size"), "seq"))
    keys = keys.orderBy("part", F.desc("score"), "size", "seq").limit(KEYS)
    order = keys.select(F.col("id").alias("target"), F.row_number().over(Window.orderBy("part", F.desc("score"), "size", "seq")).alias("key"))
    into = relations.join(F.broadcast(order), "target")
    how = F.when(F.col("type") == link, 0).when(F.col("type") == read, 1)
    ways = into.select("key", F.col("source").alias("id"), F.explode(F.filter(F.array(how, F.lit(2)), lambda x: x.isNotNull())).alias("how"), "seq")
    once = ways.groupBy("key", "how", "id").agg(F.min("seq").alias("seq"))
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("key", "how").orderBy("seq"))).where(F.col("n") <= AFFECTED)
    first = once.withColumn("m", F.row_number().over(Window.partitionBy("id").orderBy("key", "how", "seq"))).where("m = 1")
    # at most KEYS * 3 * AFFECTED rows are numbered here
    return first.select("id", "how", F.row_number().over(Window.orderBy("key", "how", "seq")).alias("rank"))


def files_for(entities: DataFrame, relations: DataFrame, term: str, limit: int = FILES) -> DataFrame:
    """``file, weight`` of the files around a term: 3 for each match's own file, 1 for each of its distinct neighbours either way."""
    found = staged(find_entity(entities, term).select("id", "file"), "matches")
    side = lambda here, there, way: touching(relations.select(here, there), here, found).select(F.col(here).alias("id"), F.col(there).alias("other"), F.lit(way).alias("way"))
    around = side("source", "target", 0).unionByName(side("target", "source", 1)).distinct().join(entities.select(F.col("id").alias("other"), "file"), "other").select("file", F.lit(1).alias("w"))
    own = found.select("file", F.lit(3).alias("w"))
    total = own.unionByName(around).where("coalesce(file, '') <> ''").groupBy("file").agg(F.sum("w").alias("weight"))
    return total.orderBy(F.desc("weight"), "file").limit(limit)


def overview(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``part, type, n`` with the totals under type "*"."""
    from .merge import stats

    each = stats(entities, relations)
    return each.unionByName(each.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.lit("*").alias("type"), "n"))
