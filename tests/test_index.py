"""The index of a small project, written here, from files to answers."""

import collections
import json

import pytest

from loomgraph import cli
from loomgraph.plans import agent, index
from loomgraph.plans.answers import Index
from loomgraph.sources import files as sources
from loomgraph.sources import pyparse
from loomgraph.sources import tables as sink

PROJECT = {
    "shop/__init__.py": "",
    "shop/base.py": 'class Item:\n    """A thing with a price."""\n\n    def price(self):\n        return 1\n',
    "shop/cart.py": (
        "from .base import Item\nimport shop.tax as tax\n\nRATE_LIMIT = 3\n\n\nclass Book(Item):\n    def price(self):\n        return tax.added(self.net())\n\n    def net(self):\n        if RATE_LIMIT > 3:\n            raise ValueError('x')\n        return 2\n\n\n"
        "class Cart:\n    def add(self, item: Item, n=1):\n        self.total(item)\n\n    def total(self, item):\n        return item.net()\n\n\ncart = Cart()\n"
    ),
    "shop/tax.py": "from shop.cart import Cart\n\n\ndef added(x):\n    return x * RATE\n",
    "shop/web.py": "@app.post('/buy')\ndef buy(request):\n    return added(request)\n\n\n@click.command()\ndef main():\n    buy(None)\n",
    "tests/test_cart.py": "from shop.cart import Book\n\n\ndef test_price():\n    assert Book().price()\n",
    "README.md": "# Shop\n\nUse shop/cart.py.\n\n## Taxes\n",
    "settings.json": '{\n  "RATE_LIMIT": 3,\n  "other": 1\n}\n',
    "lib/tool.go": "package tool\n",
    "lib/x.kt": "class X\n",
    "node_modules/skip.py": "x = 1\n",
    "data.bin.py": "\0\0",
    "bad.py": "def f(:\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in PROJECT.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def made(spark, tree):
    return index.index(spark, tree, index.Options(repo="shop"))


@pytest.fixture(scope="module")
def built(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index") / "ix")
    said = []
    assert cli.main(["index", tree, out, "--name", "shop"], spark, said.append) == 0
    assert json.loads(said[0])["entities"] > 40
    return out


def test_discovery(spark, tree):
    found = {r["rel_path"]: r for r in sources.discover(spark, tree).collect()}
    assert "node_modules/skip.py" not in found and found["data.bin.py"]["skip_reason"] == "binary"
    assert found["README.md"]["kind"] == "doc" and found["settings.json"]["kind"] == "config" and found["lib/tool.go"]["language"] == "go"
    small = {r["rel_path"]: r["skip_reason"] for r in sources.discover(spark, tree, sources.Discovery(max_bytes=30)).collect()}
    assert small["shop/cart.py"] == "too_large" and small["lib/x.kt"] is None


def edges(made, kind):
    names = {r["id"]: r["qualified_name"] for r in made["graph_entities"].collect()}
    return {(names[r["source"]], names[r["target"]]) for r in made["graph_relations"].where(f"type = '{kind}'").collect()}


def test_relations(made):
    assert ("Book", "Item") in edges(made, "INHERITS")
    calls = edges(made, "CALLS")
    # self.net() is local; item.net() is the only method of that name in the file; tax.added comes by no import of that name
    assert {("Book.price", "Book.net"), ("Cart.add", "Cart.total"), ("Cart.total", "Book.net"), ("shop/cart.py", "Cart"), ("main", "buy"), ("test_price", "Book")} <= calls
    assert ("shop.cart", "shop.base") in edges(made, "IMPORTS") and ("shop/tax.py", "shop/cart.py") in edges(made, "IMPORTS")
    assert ("Book.net", "shop/cart.py::ValueError") in edges(made, "RAISES")
    assert ("POST /buy (buy)", "buy") in edges(made, "REFERENCES") and ("shop.web.main", "main") in edges(made, "CALLS")
    assert ("test:tests/test_cart.py", "shop/cart.py") in edges(made, "TESTS") and ("test:test_price", "shop/cart.py") in edges(made, "TESTS")
    assert ("shop/cart.py", "README") in edges(made, "DOCUMENTED_BY") and ("shop/cart.py", "settings.json") in edges(made, "CONFIGURED_BY")
    assert ("README", "README#Taxes") in edges(made, "CONTAINS") and ("shop", "tests") in edges(made, "CONTAINS")


def test_entities(made):
    rows = made["graph_entities"].collect()
    by = {(r["type"], r["qualified_name"]): r for r in rows}
    assert by["class", "Book"]["location"] == "shop/cart.py:7-14" and by["class", "Book"]["attributes"]["bases"] == "Item"
    assert ("file", "lib/x.kt") in by and ("module", "lib.x") not in by and ("module", "tool") in by
    assert ("file", "bad.py") in by and by["parameter", "Cart.add.n"]["description"].endswith("with default.")
    assert len({r["id"] for r in rows}) == len(rows) == len({r["title"] for r in rows})
    ids = {r["id"] for r in rows}
    assert all(r["source"] in ids and r["target"] in ids for r in made["graph_relations"].collect())


def test_tables(made):
    units = made["text_units"].collect()
    known = {u["id"] for u in units}
    assert len(known) == len(units) and all(u["n_tokens"] >= 1 for u in units)
    assert all(set(r["text_unit_ids"]) <= known for r in made["entities"].collect())
    assert all(r["text_unit_ids"] and set(r["text_unit_ids"]) <= known for r in made["relationships"].collect())
    assert any(u["text"].startswith("[file: shop/cart.py] [language: python] [type: class] [lines: 7-14]\nclass Book") for u in units)


def test_partitions_do_not_matter(spark, tree, made):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = index.index(spark, tree, index.Options(repo="shop"))
        for name in ("graph_relations", "text_units", "relationships"):
            assert sorted(map(str, again[name].collect())) == sorted(map(str, made[name].collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_answers(spark, built):
    ix = Index(spark, built)
    for question, mode, part in (
        ("callers of buy", "callers", "main"), ("What does total call?", "callees", "Book.net"), ("Where is Cart defined?", "where", "Cart (class)"), ("who imports shop.base", "imported_by", "shop.cart"),
        ("imports of shop.cart", "imports", "shop.tax"), ("what inherits from Item", "inherits", "Book"), ("call path from main to buy", "path", "main"), ("which files involve Cart", "files", "shop/cart.py"),
        ("what code does config settings.json affect", "config", "shop/cart.py"),
    ):
        got = ix.answer(question)
        assert got.error is None and got.mode == mode and part in got.text, question
    assert "Nothing found" in ix.answer("callers of zzz_nothing").text
    for mode in ("local", "global", "basic", "drift"):
        got = ix.answer("price of a book in the cart", mode)
        assert got.error is None and got.text.startswith("(offline answer)") and any(got.context.values()), mode
    assert ix.answer("x", "no such mode").error


def test_tool_loop(spark, built):
    ix = Index(spark, built)
    rounds = [[("callers", ["buy"]), ("callers", ["buy"])], [("no_tool", ["x"])], [("code_overview", [""])]]
    got = agent.ask(ix, "Who calls buy?", lambda s: rounds[s["round"]] if s["round"] < len(rounds) else [])
    steps = collections.Counter(s for s, _ in got.trace.events)
    assert got.rounds == 3 and steps["duplicate"] == 1 and got.error is None and any("no_tool" in p for _, p in got.trace.events)
    assert agent.ask(ix, "q", lambda s: [("code_overview", [str(s["round"])])], most=2).rounds == 2
    assert agent.ask(ix, "Who calls buy?").evidence.items and all(len(p) <= agent.SHOWN + 3 for _, p in got.trace.events)
    ix.model = lambda prompt: " "
    assert agent.ask(ix, "Who calls buy?").answer.startswith("- ")


def test_command_line(spark, built):
    said = []
    assert cli.main(["query", built, "callers of buy", "--json"], spark, said.append) == 0 and json.loads(said[-1])["mode"] == "callers"
    assert cli.main(["inspect", built, "--entity", "Book", "--relations"], spark, said.append) == 0 and any("→" in x for x in said)
    assert cli.main(["inspect", built], spark, said.append) == 0 and "entity" in said[-1]
    cli.repl(Index(spark, built), ["/trace", "Who calls buy?", "/trace", "/exit", "never"], said.append)
    assert "nothing asked yet" in said and any(str(x).startswith("question: Who calls buy?") for x in said)


def test_settings_and_sidecar(spark, built):
    from loomgraph.plans.workflow import settings_of

    assert settings_of(spark, built)["options"]["repo"] == "shop"
    assert sink.redacted({"a": [{"api_key": "s", "b": 1}]}) == {"a": [{"api_key": None, "b": 1}]} and sink.rekeyed({"api_key": None}, {"API_KEY": "k"}) == {"api_key": "k"}
    rows = sink.read_sidecar(spark, f"{built}/sidecar.json", "entity", "id string, title string").collect()
    assert len({r["id"] for r in rows}) == len(rows) > 40
    assert sink.graphml(spark.read.parquet(f"{built}/graph_entities.parquet"), spark.read.parquet(f"{built}/graph_relations.parquet")).where("line like '<node%'").count() == len(rows)


def test_facts_of_bad_code():
    got = pyparse.facts("def f(:\n")
    assert got["parse_error"] and got["defs"] == [] and pyparse.facts(None)["parse_error"] is False


def test_enrichment(made):
    from loomgraph.plans.workflow import enriched

    e = made["graph_entities"]
    got = enriched(e, lambda texts: ["concept"] * len(texts), most=2)
    assert got.where("description like '% concept'").count() == 2
    assert enriched(e, lambda texts: 1 / 0).count() == e.count()


def test_back_references(spark, built):
    units = {r["id"]: r for r in spark.read.parquet(f"{built}/text_units.parquet").collect()}
    docs = spark.read.parquet(f"{built}/documents.parquet").collect()
    assert sorted(u for d in docs for u in d["text_unit_ids"]) == sorted(units)
    for e in spark.read.parquet(f"{built}/entities.parquet").collect():
        assert all(e["id"] in units[u]["entity_ids"] for u in e["text_unit_ids"])
    assert all(u["relationship_ids"] is not None for u in units.values())


def test_stats_and_graphml_are_written(spark, built):
    stats = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(f"{built}/stats.json").collect()))
    assert stats["entities"] == sum(n for k, n in stats["types"].items() if k.startswith("entity:"))
    import xml.etree.ElementTree as tree
    from pathlib import Path

    parts = sorted(Path(f"{built}/graph.graphml").glob("part-*"))
    graph = tree.fromstring("".join(p.read_text() for p in parts)).find("{*}graph")
    assert len(graph.findall("{*}node")) == stats["entities"] and len(graph.findall("{*}edge")) == stats["relations"]


def test_generic_languages_by_lines(spark, tmp_path):
    java = "package shop;\nimport java.util.List;\n\npublic class Cart extends Base {\n    public int total(List<Item> items, int tax) {\n        if (items == null) {\n            throw new Missing(1);\n        }\n        return rate(tax);\n    }\n    private int rate(int tax) {\n        return tax;\n    }\n}\n"
    rust = "use std::fs;\npub struct S {\n    a: i32,\n}\nimpl S {\n    pub fn go(&self, x: i32) -> i32 {\n        helper(x)\n    }\n}\n"
    go = 'package m\nimport "fmt"\nfunc (t *T) Run(x int) error {\n\tfmt.Println(x)\n}\n'
    js = "import { A } from './a';\nexport class B extends A {\n  run(x, y = 2) {\n    return this.go(x);\n  }\n}\nexport const f = (a) => {\n  run(a);\n};\n"
    for name, text in (("Cart.java", java), ("s.rs", rust), ("m.go", go), ("b.js", js), ("x.c", "#include <stdio.h>\nint add(int a) {\n  return sum(a);\n}\n"), ("c.cs", "using System;\npublic class C : D\n{\n    public void Run(string s)\n    {\n    }\n}\n")):
        (tmp_path / name).write_text(text)
    found = pyparse.parse_files(sources.discover(spark, str(tmp_path)), generic=True)
    rows = {r["rel_path"]: r["facts"] for r in found.collect()}
    defs = {f: [(d["kind"], d["qualified_name"], d["start_line"], d["end_line"]) for d in x["defs"]] for f, x in rows.items()}
    assert defs["Cart.java"] == [("class", "Cart", 4, 14), ("method", "Cart.total", 5, 10), ("method", "Cart.rate", 11, 13)]
    assert defs["s.rs"] == [("class", "S", 2, 4), ("method", "S.go", 6, 8)] and defs["m.go"] == [("method", "T.Run", 3, 5)]
    assert defs["b.js"] == [("class", "B", 2, 6), ("method", "B.run", 3, 5), ("function", "f", 7, 9)] and defs["x.c"] == [("function", "add", 2, 4)]
    assert defs["c.cs"] == [("class", "C", 2, 7), ("method", "C.Run", 4, 6)]
    assert rows["Cart.java"]["defs"][0]["bases"] == ["Base"] and [p["name"] for p in rows["Cart.java"]["defs"][1]["params"]] == ["items", "tax"]
    assert [(c["callee"], c["is_method_call"]) for c in rows["m.go"]["calls"]] == [("Println", True)] and rows["Cart.java"]["raises"][0]["exception"] == "Missing"
    assert {f: [i["module"] for i in x["imports"]] for f, x in rows.items()} == {"Cart.java": ["java.util.List"], "s.rs": ["std.fs"], "m.go": ["fmt"], "b.js": ["./a"], "x.c": ["stdio.h"], "c.cs": ["System"]}


def test_settings_and_models(spark, built):
    from loomgraph.operators import lookup
    from loomgraph.plans import providers

    s = providers.Settings.assembled({"provider": "hosted"}, {"LOOMGRAPH_EMBEDDING_PROVIDER": "mock", "LOOMGRAPH_DIMENSIONS": "9"})
    assert s.problems() and not s.offline and s.dim == 16 and providers.Settings().problems() == [] and providers.Settings(embedding_provider="none").problems()
    providers.MODELS["hosted"] = lambda settings: lambda prompt: f"{settings.key()}: {prompt}"
    try:
        assert s.problems() == ["provider 'hosted' needs API_KEY"]
        told = []
        keyed = providers.Settings.assembled({"provider": "hosted"}, {"API_KEY": "k"})
        assert keyed.problems() == [] and providers.teed(keyed.make_model(), told.append)("q") == "k: q" and told == ["> q\nk: q"]
        assert "k" not in keyed.stored().values()
    finally:
        del providers.MODELS["hosted"]
    rows = providers.Settings(embedding_provider="mock").embed(spark.createDataFrame([(1, "a"), (2, None)], "id int, text string"), "id", "text").collect()
    assert {r["id"]: r["vector"] and len(r["vector"]) for r in rows} == {1: 16, 2: None}
    ix = Index(spark, built)
    assert {r["file"] for r in lookup.entity_by_file(ix.entities).collect()} >= {"shop/cart.py"}
    assert agent.analysed(ix, "Who calls buy?", lambda p: '{"type": "callees", "symbols": ["main"]}')["symbol"] == "main"
    assert agent.analysed(ix, "Who calls buy?", lambda p: '{"type": "odd", "symbols": []}')["type"] == "unknown" and agent.analysed(ix, "Who calls buy?", lambda p: "no JSON")["type"] == "callers"
    got = agent.ask(ix, "Who calls buy?", lambda s: [("explore", ["callers of buy"])] if s["round"] == 0 else [], sub_agent=True)
    assert got.evidence.items[0][1] == "exploration" and got.error is None


def test_global_search_selects_from_the_top_down(spark, built):
    ix = Index(spark, built)
    rows = ix.global_context("price of a book in the cart", dynamic=True)["reports"].collect()
    flat = ix.global_context("price of a book in the cart", k=1000)["reports"].collect()
    assert rows and {r["report"] for r in rows} <= {r["report"] for r in flat}
    children = {(r["level"], r["parent"]) for r in rows if r["parent"]}
    assert not {(r["level"] + 1, r["community"]) for r in rows} & children
