"""A star schema seen as a knowledge graph: vertices and typed, weighted edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import stable_id

REPO = "warehouse"
#: Sequence numbers of one table lie in a range of their own.
SPAN = 1_000_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vertex(df: DataFrame, kind: str, rank: int, key: str, name: Column, qualified: Column, file: Column, description: Column) -> DataFrame:
    unique = F.concat(qualified, F.lit("#"), F.col(key).cast("string"))
    return df.select(
        stable_id(F.lit(kind), F.lit(REPO), file, unique).alias("id"), name.alias("name"), qualified.alias("qualified_name"), F.lit(kind).alias("type"),
        file.alias("file"), description.alias("description"), (F.lit(rank * SPAN) + F.col(key)).cast("long").alias("seq"),
    )


def vertex_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Each kind's vertices, still with their own keys in ``seq``."""
    t = lambda name: read(spark, sf_dir, name)
    c = F.col
    # regions and nations are of fixed number
    nations = F.broadcast(t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    orders = t("orders").join(t("customer").select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey"))
    none = F.lit("")
    number = c("o_orderkey").cast("string")
    return {
        "region": _vertex(t("region"), "region", 0, "r_regionkey", c("r_name"), c("r_name"), F.lit("__repo__"), none),
        "nation": _vertex(nations, "nation", 1, "n_nationkey", c("n_name"), F.concat("r_name", F.lit("."), "n_name"), c("r_name"), none),
        "customer": _vertex(t("customer").join(nations, c("c_nationkey") == c("n_nationkey")), "customer", 2, "c_custkey", c("c_name"), c("c_name"), c("n_name"), c("c_mktsegment")),
        "supplier": _vertex(t("supplier").join(nations, c("s_nationkey") == c("n_nationkey")), "supplier", 3, "s_suppkey", c("s_name"), c("s_name"), c("n_name"), none),
        "part": _vertex(t("part"), "part", 4, "p_partkey", c("p_name"), c("p_name"), c("p_brand"), c("p_type")),
        "order": _vertex(orders, "order", 5, "o_orderkey", number, F.concat("c_name", F.lit("."), number), c("o_orderpriority"), c("o_orderstatus")),
    }


def vertices(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    out = None
    for kind, df in vertex_tables(spark, sf_dir).items():
        if kinds is None or kind in kinds:
            out = df if out is None else out.unionByName(df)
    return out


def key_edges(spark: SparkSession, sf_dir: str, types: list[str] | None = None, merged: bool = True) -> DataFrame:
    """Merged relations between sequence numbers, before ids: ``source_seq, target_seq, type, weight, seq``.

    Lineitems are added up by their keys before any wide value is attached, or not at all where repeats do not matter.
    """
    t = lambda name: read(spark, sf_dir, name)
    edge = lambda df, kind, rank, a, b, place: df.select(a.cast("long").alias("source_seq"), b.cast("long").alias("target_seq"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"), (F.lit(rank * SPAN) + place).cast("long").alias("seq"))
    at = lambda rank, c: F.lit(rank * SPAN) + F.col(c)
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    parts = {
        "CONTAINS": lambda: edge(t("nation"), "CONTAINS", 0, at(0, "n_regionkey"), at(1, "n_nationkey"), F.col("n_nationkey")).unionByName(edge(t("customer"), "CONTAINS", 1, at(1, "c_nationkey"), at(2, "c_custkey"), F.col("c_custkey"))).unionByName(edge(t("supplier"), "CONTAINS", 2, at(1, "s_nationkey"), at(3, "s_suppkey"), F.col("s_suppkey"))),
        "DEFINES": lambda: edge(t("orders"), "DEFINES", 3, at(2, "o_custkey"), at(5, "o_orderkey"), F.col("o_orderkey")),
        "CALLS": lambda: edge(t("lineitem"), "CALLS", 4, at(3, "l_suppkey"), at(4, "l_partkey"), line),
        "REFERENCES": lambda: edge(t("lineitem"), "REFERENCES", 5, at(5, "l_orderkey"), at(4, "l_partkey"), line),
    }
    out = None
    for kind, make in parts.items():
        if types is None or kind in types:
            df = make()
            if merged and kind in ("CALLS", "REFERENCES"):
                df = df.groupBy("source_seq", "target_seq", "type").agg(F.sum("weight").alias("weight"), F.min("seq").alias("seq"))
            out = df if out is None else out.unionByName(df)
    return out


def edges(spark: SparkSession, sf_dir: str, types: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``source, target, type, description, weight, file, seq`` of merged relations; and both ends' titles, where ``nodes`` have them."""
    nodes = nodes if nodes is not None else vertices(spark, sf_dir)
    keyed = key_edges(spark, sf_dir, types)
    titles = "title" in nodes.columns
    end = lambda name, *more: nodes.select(F.col("seq").alias(f"{name}_seq"), F.col("id").alias(name), *([F.col("title").alias(f"{name}_title")] if titles else []), *more)
    out = keyed.join(end("source", "file"), "source_seq").join(end("target"), "target_seq")
    return out.select(*(["source_title", "target_title"] if titles else []), "source", "target", "type", F.concat("type", F.lit(": "), "source", F.lit(" "), "target").alias("description"), "weight", "file", "seq")


_ID = "substr(sha1(concat('{kind}', '|warehouse|', {file}, '|', {qn}, '#', {key})), 1, 20)"


def _vertex_sql(kind: str, rank: int, key: str, name: str, qn: str, file: str, description: str, source: str) -> str:
    return f"SELECT {_ID.format(kind=kind, file=file, qn=qn, key=f'{key}::VARCHAR')} AS id, {name} AS name, {qn} AS qualified_name, '{kind}' AS type, {file} AS file, {description} AS description, {rank * SPAN}::BIGINT + {key} AS seq FROM {source}"


#: Common table expressions of the same view for an SQL engine: v (vertices), k (key edges) and e (edges).
VERTICES_SQL = "v AS (" + " UNION ALL ".join([
    _vertex_sql("region", 0, "r_regionkey", "r_name", "r_name", "'__repo__'", "''", "region"),
    _vertex_sql("nation", 1, "n_nationkey", "n_name", "r_name || '.' || n_name", "r_name", "''", "nation JOIN region ON n_regionkey = r_regionkey"),
    _vertex_sql("customer", 2, "c_custkey", "c_name", "c_name", "n_name", "c_mktsegment", "customer JOIN nation ON c_nationkey = n_nationkey"),
    _vertex_sql("supplier", 3, "s_suppkey", "s_name", "s_name", "n_name", "''", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    _vertex_sql("part", 4, "p_partkey", "p_name", "p_name", "p_brand", "p_type", "part"),
    _vertex_sql("order", 5, "o_orderkey", "o_orderkey::VARCHAR", "c_name || '.' || o_orderkey::VARCHAR", "o_orderpriority", "o_orderstatus", "orders JOIN customer ON o_custkey = c_custkey"),
]) + ")"
_S = SPAN
EDGES_SQL = f"""{VERTICES_SQL},
k0 AS (
  SELECT {0 * _S}::BIGINT + n_regionkey AS a, {1 * _S}::BIGINT + n_nationkey AS b, 'CONTAINS' AS type, {0 * _S}::BIGINT + n_nationkey AS seq FROM nation
  UNION ALL SELECT {1 * _S}::BIGINT + c_nationkey, {2 * _S}::BIGINT + c_custkey, 'CONTAINS', {1 * _S}::BIGINT + c_custkey FROM customer
  UNION ALL SELECT {1 * _S}::BIGINT + s_nationkey, {3 * _S}::BIGINT + s_suppkey, 'CONTAINS', {2 * _S}::BIGINT + s_suppkey FROM supplier
  UNION ALL SELECT {2 * _S}::BIGINT + o_custkey, {5 * _S}::BIGINT + o_orderkey, 'DEFINES', {3 * _S}::BIGINT + o_orderkey FROM orders
  UNION ALL SELECT {3 * _S}::BIGINT + l_suppkey, {4 * _S}::BIGINT + l_partkey, 'CALLS', {4 * _S}::BIGINT + l_orderkey * 10 + l_linenumber FROM lineitem
  UNION ALL SELECT {5 * _S}::BIGINT + l_orderkey, {4 * _S}::BIGINT + l_partkey, 'REFERENCES', {5 * _S}::BIGINT + l_orderkey * 10 + l_linenumber FROM lineitem),
k AS (SELECT a, b, type, count(*)::DOUBLE AS weight, min(seq) AS seq FROM k0 GROUP BY a, b, type),
e AS (SELECT s.id AS source, t.id AS target, k.type, k.type || ': ' || s.id || ' ' || t.id AS description, k.weight, s.file, k.seq
  FROM k JOIN v s ON k.a = s.seq JOIN v t ON k.b = t.seq)"""
