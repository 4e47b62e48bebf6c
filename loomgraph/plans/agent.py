"""A tool-calling loop over an index. The model is pluggable; without one, the question's type decides the tools."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions import route
from ..operators import evidence as ev
from ..operators import lookup, search
from .answers import Index

#: Rounds of tool calls, rows that a tool shows, characters of payloads in a trace.
ROUNDS, ROWS, SHOWN = 6, 8, 300


@dataclass
class Trace:
    events: list[tuple[str, str]] = field(default_factory=list)

    def add(self, step: str, payload) -> None:
        text = payload if isinstance(payload, str) else json.dumps(payload, default=str, sort_keys=True)
        self.events.append((step, text if len(text) <= SHOWN else text[:SHOWN] + "..."))

    def frame(self, spark):
        return spark.createDataFrame(self.events, "step string, payload string")


class Evidence:
    """Pieces of evidence, each kept once; rendered within a budget by the same operators as any table of evidence."""

    SCHEMA = "source string, kind string, title string, content string, weight double, loc string, seq long"

    def __init__(self):
        self.items: list[tuple] = []
        self.duplicates = 0
        self._keys: set[str] = set()

    def add(self, source: str, kind: str, title: str, content: str, weight: float = 1.0, loc: str = "") -> bool:
        key = f"{kind}:{title.strip().lower()}:{hashlib.md5(content.encode()).hexdigest()[:10]}"
        if key in self._keys:
            self.duplicates += 1
            return False
        self._keys.add(key)
        self.items.append((source, kind, title, content, float(weight), loc, len(self.items)))
        return True

    def frame(self, spark):
        return spark.createDataFrame(self.items, self.SCHEMA)

    def rendered(self, spark, budget: int = ev.BUDGET) -> str:
        return "\n\n".join(r["block"] for r in ev.within_budget(self.frame(spark), budget).orderBy("place").collect())


def _symbols(df, kind: str):
    def rows():
        cols = [c for c in ("qualified_name", "type", "location", "file", "description") if c in df.columns]
        for r in df.select(*cols).limit(ROWS).collect():
            yield kind, r["qualified_name"], (r["description"] or "")[:300], r["location"] if "location" in cols else r["file"]

    return rows()


def tools(ix: Index) -> dict[str, Callable]:
    """Tools by name; each takes one or two strings and yields (kind, title, content, place) rows."""
    e, r, t = ix.entities, ix.relations, ix.t

    def relations(a: str, b: str = ""):
        df = search.relations_between(e, r, a, b) if b else search.find_relations(t["relationships"], a)
        for x in df.collect():
            yield "relation", f"{x['source']} → {x['target']}", x["description"] or "", ""

    def titles(term: str):
        for x in search.find_titles(t["entities"], term).collect():
            yield "entity", x["title"], x["description"] or "", ""

    def text(kind: str, df):
        for x in df.limit(ROWS).collect():
            yield kind, x["file"] or x["id"], x["text"], x["file"] or ""

    def fetch(title: str):
        some = search.find_titles(t["entities"], title, limit=1)
        for x in search.snippets(some, t["text_units"]).orderBy("place").collect():
            yield "source", x["title"], x["text"], f"{x['file']}:{x['start_line']}-{x['end_line']}" if x["start_line"] else x["file"] or ""

    def semantic(mode: str):
        def ask(question: str):
            a = ix.search(question, mode)
            yield mode, question, a.text, ""

        return ask

    def overview(_: str = ""):
        for x in lookup.overview(e, r).collect():
            yield "overview", f"{x['part']} {x['type']}", str(x["n"]), ""

    def files(term: str):
        for x in lookup.files_for(e, r, term).collect():
            yield "file", x["file"], f"weight {x['weight']}", x["file"]

    return {
        "search_code_symbol": lambda s: _symbols(lookup.where_is(e, s).orderBy("rank"), "symbol"), "search_entity": titles, "search_relationship": relations,
        "callers": lambda s: _symbols(lookup.callers(e, r, s).orderBy("first"), "caller"), "callees": lambda s: _symbols(lookup.callees(e, r, s).orderBy("first"), "callee"),
        "imports_of": lambda s: _symbols(lookup.imports_of(e, r, s).orderBy("first"), "import"), "imported_by": lambda s: _symbols(lookup.imported_by(e, r, s).orderBy("first"), "importer"),
        "inheritance": lambda s: _symbols(lookup.inherits(e, r, s).orderBy("direction", "first"), "class"), "fetch_source_snippets": fetch,
        "search_source": lambda s: text("source", search.search_source(t["text_units"], s)), "search_documentation": lambda s: text("documentation", search.search_documentation(t["text_units"], s)),
        "local_graph_search": semantic("local"), "global_graph_search": semantic("global"), "code_overview": overview,
        "call_path": lambda a, b="": _symbols(lookup.call_path(e, r, a, b).orderBy("step"), "path"), "related_files": files,
        "config_impact": lambda s: _symbols(e.join(lookup.config_affects(e, r, s), "id").orderBy("rank"), "affected"),
    }


#: What is called for each type of question if no model decides.
PLANS = {
    "callers": ["search_code_symbol", "callers"], "callees": ["search_code_symbol", "callees"], "module_dependency": ["imports_of", "imported_by"], "inheritance": ["inheritance"],
    "call_path": ["call_path"], "config_impact": ["config_impact"], "documentation": ["search_documentation"], "code_location": ["search_code_symbol", "fetch_source_snippets"],
    "architecture": ["code_overview", "global_graph_search"], "feature_explanation": ["search_code_symbol", "local_graph_search"],
}


def analysed(ix: Index, question: str, model: Callable[[str], str] | None = None) -> dict:
    """:func:`analysis`, with type and symbols by a model that answers in JSON; what it can't say is told by patterns."""
    about = analysis(ix, question)
    if model is None:
        return about
    known = [t for t, _ in route.TYPES]
    try:
        said = json.loads(model(f"Give JSON with type (one of {', '.join(known)}) and symbols (a list) of this question.\n{question}"))
        symbols = [str(s) for s in said["symbols"]]
    except Exception:  # noqa: BLE001  a model's failure leaves the patterns' answer
        return about
    kind = said.get("type") if said.get("type") in known else "unknown"
    return about | {"type": kind, "symbols": symbols or about["symbols"], "symbol": symbols[0] if symbols else about["symbol"]}


def analysis(ix: Index, question: str) -> dict:
    """The type of a question and its symbols, by patterns."""
    row = ix.spark.createDataFrame([(question,)], "q string").select(route.question_type(F.col("q")).alias("type"), route.question_symbols(F.col("q")).alias("symbols"), route.symbol(F.col("q")).alias("symbol"), route.path_symbols(F.col("q")).alias("path"), route.hint(route.question_type(F.col("q"))).alias("hint")).first()
    return row.asDict(True)


def planned(state: dict) -> list[tuple[str, list[str]]]:
    """The stand-in for a model's decisions: the plan of the question's type in the first round, nothing after it."""
    if state["round"]:
        return []
    about = state["analysis"]
    ends = [about["path"]["source"], about["path"]["target"]]
    ends = ends if all(ends) else (about["symbols"] or [about["symbol"]])[:2]
    calls = []
    for name in PLANS.get(about["type"], ["search_code_symbol", "local_graph_search"]):
        whole = name.endswith("graph_search") or name == "code_overview"
        calls.append((name, [state["question"]] if whole else ends if name == "call_path" else [about["symbol"]]))
    return calls


@dataclass
class Result:
    question: str
    answer: str
    rounds: int
    evidence: Evidence
    trace: Trace
    error: str | None = None


def explorer(ix: Index, decide: Callable[[dict], list[tuple[str, list[str]]]] = planned, most: int = 2) -> Callable:
    """A tool that answers a narrower question in a loop of its own, over the same tools but itself."""

    def explore(question: str):
        got = ask(ix, question, decide, most)
        yield "exploration", question, got.answer, ""

    return explore


def ask(ix: Index, question: str, decide: Callable[[dict], list[tuple[str, list[str]]]] = planned, most: int = ROUNDS, budget: int = ev.BUDGET, analyst: Callable[[str], str] | None = None, sub_agent: bool = False) -> Result:
    """Analyse, let ``decide`` call tools for at most ``most`` rounds, and word the evidence.

    Beyond the last round no tool is called any more: the model words what there is. ``analyst`` is a model for the
    analysis; with ``sub_agent`` the tool ``explore`` asks in a loop of its own.

    A call that was made before is answered from memory, an unknown tool by a message; a tool's failure is evidence, too.
    If the model words nothing, the ten heaviest pieces of evidence are the answer.
    """
    trace, found, seen = Trace(), Evidence(), {}
    trace.add("question", question)
    about = analysed(ix, question, analyst)
    trace.add("analysis", about)
    known, rounds, error = tools(ix) | ({"explore": explorer(ix)} if sub_agent else {}), 0, None
    try:
        while rounds < most:
            calls = decide({"question": question, "analysis": about, "round": rounds, "seen": list(seen), "evidence": found.items})
            if not calls:
                break
            rounds += 1
            for name, args in calls:
                signature = json.dumps([name, args])
                if signature in seen:
                    trace.add("duplicate", signature)
                    continue
                trace.add("tool_call", signature)
                if name not in known:
                    seen[signature] = f"There is no tool {name!r}."
                    trace.add("tool_result", seen[signature])
                    continue
                try:
                    rows = list(known[name](*args))
                except Exception as e:  # noqa: BLE001  one tool's failure doesn't end the loop
                    rows = [("error", name, f"{type(e).__name__}: {e}"[:300], "")]
                for kind, title, content, place in rows:
                    found.add(name, kind, title, content, 0.0 if kind == "error" else 1.0, place or "")
                seen[signature] = len(rows)
                trace.add("tool_result", f"{name}: {len(rows)} rows")
        text = found.rendered(ix.spark, budget) if found.items else ""
        trace.add("synthesis", f"{len(found.items)} pieces, {found.duplicates} repeated")
        answer = ix.model(f"{question}\n{text}") if text else "No evidence was found."
        if not answer.strip():
            answer = "\n".join(f"- {i[2]}: {i[3][:160]}" for i in sorted(found.items, key=lambda i: (-i[4], i[6]))[:10])
    except Exception as e:  # noqa: BLE001
        answer, error = "", f"{type(e).__name__}: {e}"[:500]
    trace.add("answer", answer)
    return Result(question, answer, rounds, found, trace, error)
