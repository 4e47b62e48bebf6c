import duckdb
import pytest

from loomgraph.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = df.toArrow().select(cols).to_pylist()
    want = con.sql(ORACLES[name]).to_arrow_table().select(cols)
    key = lambda x: tuple((v is None, str(v)) for v in x.values())
    assert sorted(got, key=key) == sorted(want.to_pylist(), key=key) and len(got) > 0
    kinds = {str(f.type) for f in want.schema}
    assert not any("decimal" in k or "128" in k for k in kinds)
