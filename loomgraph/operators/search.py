"""Text and title search over entity, relation and text-unit tables, and snippets of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import header_fields, occurrences, title_score
from .lookup import best

#: Rows that a search shows.
LIMIT = 8
#: Endings of documentation files: those that source search leaves out, and those that documentation search takes.
NOT_SOURCE, DOCUMENTATION = [".md", ".rst", ".txt"], [".md", ".mdx", ".rst", ".txt"]


def find_titles(entities: DataFrame, term: str, types: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """The entities whose title fits best, with ``score``; of equal scores the longest title comes first."""
    some = entities.where(F.col("type").isin(types)) if types else entities
    scored = some.withColumn("score", title_score(F.col("title"), F.lit(term))).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc(F.length("title")), "seq").limit(limit)


def relations_between(entities: DataFrame, relations: DataFrame, source: str, target: str, kind: str | None = None, limit: int = LIMIT, matches: int = 2) -> DataFrame:
    """Relations, either way, between the best matches of two terms; those with the longest description come first."""
    a = best(entities, source, limit=matches).select(F.col("id").alias("from_id"))
    b = best(entities, target, limit=matches).select(F.col("id").alias("to_id"))
    # matches * matches pairs
    pairs = F.broadcast(a.crossJoin(b).select("from_id", "to_id", F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi")))
    some = relations.where(F.col("type") == kind) if kind else relations
    keyed = some.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    return keyed.join(pairs, ["lo", "hi"]).drop("lo", "hi").orderBy(F.desc(F.length("description")), "seq").limit(limit)


def find_relations(relations: DataFrame, term: str, kind: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Relations (source and target titles, description ``TYPE: text``) that hold the term, the heaviest first."""
    t = F.lit(term.lower())
    holds = F.contains(F.lower("source"), t) | F.contains(F.lower("target"), t) | F.contains(F.lower("description"), t)
    some = relations.where(F.startswith("description", F.lit(f"{kind}:"))) if kind else relations
    return some.where(holds).orderBy(F.desc("weight"), "seq").limit(limit)


def entity_full(sidecar: DataFrame, table: DataFrame) -> DataFrame:
    """Both sides of each title: the sidecar's fields where it has any, else the table's."""
    a = sidecar.select([F.col(c).alias(c if c == "title" else f"a_{c}") for c in sidecar.columns])
    b = table.select([F.col(c).alias(c if c == "title" else f"b_{c}") for c in table.columns])
    both = a.join(b, "title", "full_outer")
    names = [c for c in dict.fromkeys([*sidecar.columns, *table.columns]) if c != "title"]
    pick = lambda c: F.coalesce(*[F.col(f"{p}_{c}") for p, df in (("a", sidecar), ("b", table)) if c in df.columns]).alias(c)
    return both.select("title", *[pick(c) for c in names])


def snippets(entities: DataFrame, units: DataFrame, limit: int = 3) -> DataFrame:
    """``title, place, unit_id, file, start_line, end_line, text`` of each entity's first text units."""
    listed = entities.select("title", F.posexplode(F.slice(F.coalesce("text_unit_ids", F.array().cast("array<string>")), 1, limit)).alias("place", "unit_id"))
    found = listed.join(units.select(F.col("id").alias("unit_id"), "text"), "unit_id").withColumn("h", header_fields(F.col("text")))
    return found.select("title", "place", "unit_id", "h.file", "h.start_line", "h.end_line", "text")


def _search(units: DataFrame, term: str, limit: int) -> DataFrame:
    hits = units.withColumn("hits", occurrences(F.col("text"), F.lit(term))).where("hits > 0")
    return hits.orderBy(F.desc("hits"), "seq").limit(limit)


def _file(units: DataFrame) -> DataFrame:
    return units.withColumn("file", header_fields(F.col("text"))["file"])


def _ends(endings: list[str]):
    return F.rlike(F.lower(F.coalesce("file", F.lit(""))), F.lit("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))


def search_source(units: DataFrame, term: str, limit: int = LIMIT) -> DataFrame:
    """Text units outside documentation, by how often they hold the term; ties keep the units' order."""
    return _search(_file(units).where(~_ends(NOT_SOURCE)), term, limit)


def search_documentation(units: DataFrame, term: str, limit: int = LIMIT) -> DataFrame:
    return _search(_file(units).where(_ends(DOCUMENTATION)), term, limit)
