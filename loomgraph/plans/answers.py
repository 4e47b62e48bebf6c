"""Questions over an index: deterministic graph queries, and searches whose answers a pluggable model words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import route, vectors
from ..operators import lookup, mapreduce, search
from ..sources import tables as sink
from .embed import nearest_vectors
from .providers import Model, Settings, offline_model
from .workflow import TABLES, settings_of

ROWS = 20


@dataclass
class Answer:
    question: str
    mode: str
    text: str
    rows: list[dict] = field(default_factory=list)
    context: dict[str, list[dict]] = field(default_factory=dict)
    error: str | None = None


class Index:
    """An index on disk. Methods that are named after queries give DataFrames; ``answer`` renders at most ROWS of them."""

    def __init__(self, spark: SparkSession, path: str, model: Model = offline_model):
        self.spark, self.path, self.model = spark, path, model
        self.t = sink.read_tables(spark, path, TABLES)
        self.entities, self.relations = self.t["graph_entities"], self.t["graph_relations"]
        # questions are embedded as the index was
        models = settings_of(spark, path)["models"]
        self.settings = Settings(embedding_provider=models["embedding_provider"], embedding_model=models["embedding_model"], dimensions=models["dim"])

    # -- deterministic ------------------------------------------------------------------------------------------------

    def run(self, mode: str, question: str) -> DataFrame:
        s = self._scalar(question, route.symbol)
        e, r = self.entities, self.relations
        if mode == "path":
            two = self._scalar(question, route.path_symbols)
            return lookup.call_path(e, r, two["source"] or s, two["target"] or s).orderBy("step")
        plain = {
            "where": lambda: lookup.where_is(e, s).orderBy("rank"), "callers": lambda: lookup.callers(e, r, s).orderBy("first"), "callees": lambda: lookup.callees(e, r, s).orderBy("first"),
            "imports": lambda: lookup.imports_of(e, r, s).orderBy("first"), "imported_by": lambda: lookup.imported_by(e, r, s).orderBy("first"), "inherits": lambda: lookup.inherits(e, r, s).orderBy("direction", "first"),
            "config": lambda: e.join(lookup.config_affects(e, r, s), "id").orderBy("rank"), "files": lambda: lookup.files_for(e, r, s), "overview": lambda: lookup.overview(e, r).orderBy("part", F.desc("n"), "type"),
        }
        return plain[mode]()

    def _scalar(self, text: str, f):
        return self.spark.createDataFrame([(text,)], "q string").select(f(F.col("q")).alias("a")).first()["a"]

    def mode_of(self, question: str) -> str:
        return self._scalar(question, route.mode) or "local"

    def answer(self, question: str, mode: str | None = None) -> Answer:
        """Never fails: what goes wrong is in ``error``."""
        mode = mode or self.mode_of(question)
        try:
            if mode in route.SEMANTIC_MODES:
                return self.search(question, mode)
            rows = [r.asDict(True) for r in self.run(mode, question).limit(ROWS).collect()]
            return Answer(question, mode, self._rendered(mode, question, rows), rows)
        except Exception as e:  # noqa: BLE001  a question is answered, if only by what went wrong
            return Answer(question, mode, "", error=f"{type(e).__name__}: {e}"[:500])

    def _rendered(self, mode: str, question: str, rows: list[dict]) -> str:
        if not rows:
            return f"Nothing found for {question!r} ({mode})."
        if mode == "files":
            lines = [f"{r['file']} (weight {r['weight']})" for r in rows]
        elif mode == "overview":
            lines = [f"{r['part']} {r['type']}: {r['n']}" for r in rows]
        else:
            lines = [f"{r['qualified_name']} ({r['type']}) at {r.get('location') or r['file']}" for r in rows]
        return "\n".join(["\n→ ".join(lines)] if mode == "path" else [f"- {x}" for x in lines]) + "\n[source: code graph]"

    # -- searches -----------------------------------------------------------------------------------------------------

    def _nearest(self, question: str, part: str, k: int) -> DataFrame:
        q = self.settings.embed(self.spark.createDataFrame([(0, question)], "query_id int, text string"), "query_id", "text")
        table = self.t["embeddings"].where(F.col("part") == part).select("key", "vector")
        return nearest_vectors(q, table, k, key="key").where("similarity > 0").select("key", "similarity", "rank")

    def _similar(self, question: str, part: str) -> DataFrame:
        """``key, similarity`` of all rows that share anything with the question, unranked: the question's vector is a literal."""
        q = self.settings.embed(self.spark.createDataFrame([(0, question)], "query_id int, text string"), "query_id", "text").first()["vector"]
        table = self.t["embeddings"].where(F.col("part") == part)
        return table.select("key", vectors.cosine(F.col("vector"), F.array(*map(F.lit, q))).alias("similarity")).where("similarity > 0")

    def local_context(self, question: str, k: int = 10, level: int = 2) -> dict[str, DataFrame]:
        """The nearest entities, their relationships and text units, and reports of their communities."""
        near = self._nearest(question, "entity", k).withColumnRenamed("key", "title")
        top = F.broadcast(near)
        found = self.t["entities"].join(top, "title").orderBy("rank")
        units = search.snippets(self.t["entities"].join(top.select("title"), "title", "left_semi"), self.t["text_units"]).select("unit_id", "file", "text").distinct()
        ends = F.broadcast(near.select("title"))
        rel = self.t["relationships"]
        around = rel.join(ends.withColumnRenamed("title", "source"), "source", "left_semi").unionByName(rel.join(ends.withColumnRenamed("title", "target"), "target", "left_semi").select(rel.columns)).distinct()
        ids = self.entities.join(ends, "title").select("id")
        inside = self.t["community_members"].where(F.col("level") <= level).select("level", "community", "id").join(F.broadcast(ids), "id").select("level", "community").distinct()
        reports = self.t["community_reports"].join(inside, ["level", "community"])
        return {"entities": found, "relationships": around.orderBy(F.desc("weight"), "seq"), "text_units": units.orderBy("unit_id"), "reports": reports.orderBy("level", "community")}

    def global_context(self, question: str, k: int = 10, level: int = 2, dynamic: bool = False) -> dict[str, DataFrame]:
        """Reports up to a level, the relevant ones first; those that share nothing with the question are left out.

        With ``dynamic`` the selection goes from the top down: a community is looked at only if its parent was relevant,
        and of a community and its children that are relevant the children count.
        """
        name = F.concat(F.col("level").cast("string"), F.lit("/"), "community")
        named = self.t["community_reports"].where(F.col("level") <= level).withColumn("report", name)
        if not dynamic:
            near = self._nearest(question, "report", k).withColumnRenamed("key", "report")
            return {"reports": named.join(F.broadcast(near), "report").orderBy("rank")}
        every = self._similar(question, "report").withColumnRenamed("key", "report")
        scored = named.join(every, "report").join(self.t["communities"].select("level", "community", "parent").distinct(), ["level", "community"])
        kept = scored.where("level = 0")
        for below in range(1, level + 1):
            above = kept.where(F.col("level") == below - 1).select(F.col("community").alias("parent"))
            kept = kept.unionByName(scored.where(F.col("level") == below).join(above, "parent", "left_semi").select(kept.columns))
        parents = kept.where("parent is not null").select((F.col("level") - 1).alias("level"), F.col("parent").alias("community")).distinct()
        return {"reports": kept.join(parents, ["level", "community"], "left_anti").orderBy(F.desc("similarity"), "report").limit(k)}

    def basic_context(self, question: str, k: int = 10) -> dict[str, DataFrame]:
        near = self._nearest(question, "unit", k).withColumnRenamed("key", "id")
        return {"text_units": self.t["text_units"].join(F.broadcast(near), "id").orderBy("rank")}

    def search(self, question: str, mode: str = "local", level: int = 2) -> Answer:
        if mode == "drift":
            return self.drift(question, level)
        make = {"local": lambda: self.local_context(question, level=level), "global": lambda: self.global_context(question, level=level, dynamic=True), "basic": lambda: self.basic_context(question)}[mode]
        rows = {name: [r.asDict(True) for r in df.limit(ROWS).collect()] for name, df in make().items()}
        if mode == "global":
            # all relevant reports count, not only those that are shown
            named = self.t["community_reports"].where(F.col("level") <= level)
            reports = named.select(F.xxhash64("level", "community").alias("seq"), "title", F.col("full_content").alias("content"))
            best = mapreduce.reduced(mapreduce.points(mapreduce.packed(reports, question), question)).orderBy("place").collect()
            return Answer(question, mode, self.model("\n".join([question, *[f"{r['point']} ({r['rating']:g}, {r['reports']} reports)" for r in best]])), context=rows)
        shown = [f"{k}: {r.get('title') or r.get('unit_id') or r.get('id') or r.get('description')}" for k, some in rows.items() for r in some]
        return Answer(question, mode, self.model("\n".join([question, *shown])), context=rows)

    def drift(self, question: str, level: int = 2, depth: int = 2, width: int = 2) -> Answer:
        """A primer over community reports, then local searches that follow up what the last ones found, each subject once."""
        primer = self.global_context(question, k=5, level=level)["reports"].select("title", "summary").collect()
        said, asked, follow_ups, context = [f"{r['title']}: {r['summary']}" for r in primer], set(), [], {}
        queue = [(question, 0)]
        while queue:
            text, at = queue.pop(0)
            found = self.search(text, "local", level)
            context = context or found.context
            said.append(found.text)
            if at:
                follow_ups.append({"question": text, "answer": found.text})
            new = [r["title"] for r in found.context.get("entities", []) if r["title"] not in asked][:width]
            asked.update(new)
            queue += [(f"{question} {t}", at + 1) for t in new if at < depth - 1]
        return Answer(question, "drift", self.model("\n".join([question, *said])), context=context | {"primer": [r.asDict() for r in primer], "follow_ups": follow_ups})
