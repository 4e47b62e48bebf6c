"""Functions by name in SQL against the column functions and the parser."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import identity, sql, vectors
from loomgraph.sources.pyparse import facts

TEXT = "import os\n\nLIMIT = 3\n\n\nclass A(B):\n    def go(self, x=1):\n        raise Bad(os.path)\n"


@pytest.fixture(scope="module")
def known(spark):
    sql.register(spark)
    return spark


def test_scalar_functions_are_the_column_functions(known):
    c = F.col
    rows = [("go", "A.go", "GO", "f.py", 3, 9), ("A", "A", "a", "f.py", 0, 0), ("b", "x.y", "Y", "g", 4, 4), (None, "A.b", "a", None, None, 2), ("é", "É", "é", "h", 1, None), ("", "", "", "", 5, 1)]
    df = known.createDataFrame(rows, "n string, q string, t string, f string, a long, b long")
    want = df.select(
        identity.stable_id(c("n"), c("q"), c("t"), c("f")), identity.match_score(c("n"), c("q"), c("t")), identity.title_score(c("q"), c("t")), identity.location(c("f"), c("a"), c("b")), identity.token_count(c("q")), vectors.bucket(c("q")),
    )
    got = known.sql("SELECT stable_id(n, q, t, f), match_score(n, q, t), title_score(q, t), location(f, a, b), token_count(q), hash_bucket(q) FROM {df}", df=df)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_facts_of_each_kind(known):
    files = known.createDataFrame([("a.py", TEXT), ("bad.py", "def f(:"), ("none.py", None), ("empty.py", "")], "path string, text string")
    whole = facts(TEXT)
    for kind in sql.KINDS:
        got = known.sql(f"SELECT f.path, d.* FROM {{files}} f, LATERAL source_facts(f.text, '{kind}') d", files=files).collect()
        want = whole[{"definitions": "defs", "assignments": "assigns"}.get(kind, kind)]
        assert want and len(got) == len(want) and {r["path"] for r in got} == {"a.py"}
        for r, w in zip(got, want):
            assert all(r[n] == w[n] for n in r.asDict() if n in w)
    assert [r["n_params"] for r in known.sql("SELECT d.* FROM {files} f, LATERAL source_facts(f.text, 'definitions') d", files=files).collect()] == [0, 2]


def test_an_unknown_kind_is_told_before_any_row_is_read(known):
    with pytest.raises(Exception, match="kind must be one of"):
        known.sql("SELECT * FROM source_facts('x', 'no such kind')").schema


def test_rows_without_facts_give_none(known):
    files = known.createDataFrame([("a", None), ("b", "raise X\n")], "path string, text string")
    got = known.sql("SELECT f.path, d.exception FROM {files} f, LATERAL source_facts(f.text, 'raises') d", files=files).collect()
    assert [tuple(r) for r in got] == [("b", "X")]
