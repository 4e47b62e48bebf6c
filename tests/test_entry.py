import importlib
import sys

import __spark_entry__


def test_every_oracle_has_its_query():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40


def test_the_flagship_gives_rows(spark, sf):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_the_rest_works_without_the_subpackage(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("loomgraph.llm"):
                raise ModuleNotFoundError(name, name=name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("loomgraph.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    fresh = importlib.reload(__spark_entry__)
    assert fresh.llm is None and "entity_ids" in fresh.queries() and not any(n.startswith("op") for n in fresh.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
