"""Reports in batches, their points, and what is put together of them."""

from loomgraph.operators import mapreduce

QUESTION = "Where is the price of a book worked out?"


def reports(spark):
    rows = [(i, f"t{i % 7}", ("price " if i % 2 else "") + ("book " if i % 3 == 0 else "") + "x" * (i % 50)) for i in range(300)] + [(900, "none", None), (901, "long", "price of a book " * 5000)]
    return rows, spark.createDataFrame(rows, "seq long, title string, content string").repartition(4)


def test_batches_hold_all_relevant_reports_within_the_budget(spark):
    rows, df = reports(spark)
    got = mapreduce.packed(df, QUESTION, budget=200, parts=3).collect()
    words = mapreduce.terms(QUESTION)
    assert words == ["book", "out", "price", "the", "where", "worked"]
    want = {i for i, _, c in rows if any(w in (c or "").lower() for w in words)}
    assert {r["seq"] for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault((r["part"], r["batch"]), []).append(r)
    assert len(by) > 3 and {p for p, _ in by} == {0, 1, 2}
    for (part, batch), some in by.items():
        some.sort(key=lambda r: (-r["relevance"], r["seq"]))
        assert all(r["seq"] % 3 == part for r in some)
        # all but the last begin and end within the budget
        assert sum(min(200, len(r["content"])) for r in some[:-1]) <= 200
        later = by.get((part, batch + 1))
        assert not later or min(r["relevance"] for r in some) >= max(r["relevance"] for r in later)


def test_points_of_a_model_are_merged_by_rating(spark):
    _, df = reports(spark)

    def rater(question, text):
        return [("about " + w, 10.0 * len(w)) for w in ("price", "book") if w in text] + [("nothing", 0.0)]

    made = mapreduce.points(mapreduce.packed(df, QUESTION, budget=200, parts=3), QUESTION, rater, budget=200)
    got = [tuple(r) for r in mapreduce.reduced(made).orderBy("place").collect()]
    assert got == [(1, "about price", 50.0, 151), (2, "about book", 40.0, 101)]
    assert [tuple(r)[:2] for r in mapreduce.reduced(made, budget=12).collect()] == [(1, "about price")]
    none = mapreduce.packed(df.limit(0), QUESTION)
    assert mapreduce.reduced(mapreduce.points(none, QUESTION)).collect() == []
    assert mapreduce.packed(df, "?!").count() == 0
