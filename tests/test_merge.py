from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators import evidence, merge
from loomgraph.streaming.merge import merge_into, merged

ROWS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xy"), st.sampled_from("RS"), st.integers(1, 5)), min_size=1, max_size=25)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(rows=ROWS)
def test_relations_against_a_plain_model(spark, rows):
    want = {}
    for i, (s, t, k, w) in enumerate(rows):
        first = want.setdefault((s, t, k), [0, f"d{i}", i])
        first[0] += w
    df = spark.createDataFrame([(s, t, k, f"d{i}", float(w), i) for i, (s, t, k, w) in enumerate(rows)], "source string, target string, type string, description string, weight double, seq long")
    got = {(r["source"], r["target"], r["type"]): [r["weight"], r["description"], r["seq"]] for r in merge.merge_relations(df.repartition(3)).collect()}
    assert got == want


@SLOW
@given(names=st.lists(st.tuples(st.sampled_from(["a", "b", "a (f) #1"]), st.sampled_from("fg")), min_size=1, max_size=12))
def test_titles_are_unique_unless_a_name_looks_like_one(spark, names):
    df = spark.createDataFrame([(str(i), q, q, f, i) for i, (q, f) in enumerate(names)], "id string, name string, qualified_name string, file string, seq long")
    titles = [r["title"] for r in merge.unique_titles(df).orderBy("seq").collect()]
    if "a (f) #1" not in [q for q, _ in names]:
        assert len(set(titles)) == len(titles)
    seen = set()
    for (q, _), t in zip(names, titles):
        assert (t == q) == (q not in seen)
        seen.add(q)


def test_entities_take_the_first_words_and_the_last_attributes(spark):
    rows = [("i", "n1", "", {"k": "1", "a": "x"}, 5), ("i", "n0", "", {"k": "0"}, 2), ("i", "n2", "said", {"k": "2"}, 9), ("i", "n3", "later", {}, 11)]
    got = merge.merge_entities(spark.createDataFrame(rows, "id string, name string, description string, attributes map<string,string>, seq long")).first()
    assert (got["name"], got["description"], got["attributes"], got["seq"]) == ("n0", "said", {"k": "2", "a": "x"}, 2)


def test_budget(spark):
    rows = [("s", "k", f"t{i}", "x" * 300, float(-i), "", i) for i in range(4)]
    df = spark.createDataFrame(rows, "source string, kind string, title string, content string, weight double, loc string, seq long")
    got = evidence.within_budget(df, 700).orderBy("place").collect()
    assert [len(r["block"]) for r in got][:2] == [313, 313] and len(got) == 2
    got = evidence.within_budget(df, 900).orderBy("place").collect()
    assert len(got) == 3 and got[2]["block"].endswith("[truncated]")
    assert evidence.within_budget(df.limit(0), 10).count() == 0


def test_streamed_relations(spark, tmp_path):
    schema = "source string, target string, type string, description string, weight double, seq long"
    rows = [("a", "b", "R", f"d{i}", 1.0, i) for i in range(10)] + [("a", "c", "R", "x", 2.0, 20)]
    whole = spark.createDataFrame(rows, schema)
    whole.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge_into(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(str, merged(spark, str(tmp_path / "out")).select(whole.columns).collect())) == sorted(map(str, merge.merge_relations(whole).select(whole.columns).collect()))


def test_degrees(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")], "source string, target string")
    assert {r["id"]: r["degree"] for r in merge.degrees(df).collect()} == {"a": 3, "b": 1, "c": 1}
