import hashlib

import corpus_pipeline
from loomgraph.llm import decontaminate, toxicity
from loomgraph.llm.queries import ranks_path


def test_stages_by_brute_force(spark, sf):
    """Each stage's decisions, worked out once more without Spark's operators where that is possible."""
    from tests.llm.test_lines_and_benchmark import brute as line_brute
    from tests.llm.test_lines_and_benchmark import left
    from tests.llm.test_near_dedup import brute as near_brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = toxicity.model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {d: t for d, t in texts.items() if model.scores([t.encode()])[0] < 0.5}
    gone = line_brute(list(texts.items()))
    texts = {d: left(t.encode(), gone[d]).decode() for d, t in texts.items()}
    near = near_brute(list(texts.items()))
    texts = {d: t for d, t in texts.items() if near[d][1] == d}
    items = [p for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (p := decontaminate.fold(r["text"]))]
    matcher = decontaminate.Matcher(list(enumerate(items)))
    texts = {d: t for d, t in texts.items() if not matcher.matches(t)}
    assert all(p not in decontaminate.fold(t) for t in texts.values() for p in items)

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert {d: r["text"] for d, r in kept.items()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and ranks_path()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def tables(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_awkward_rows(spark, odd, tmp_path):
    """Nulls, empty texts, repeated rows, labels that say nothing and clashing columns go through all stages."""
    sf = tables(spark, tmp_path / "odd", odd, [(1, "Repeated row with the same words twice in the table."), (2, None), (None, "one")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    line = corpus_pipeline.drop_repeated_lines(spark, docs, sf)
    assert line.columns == docs.columns
    lost = {r["doc_id"]: r for r in line.collect()}
    assert (lost[1]["text"], lost[1]["n_chars"], lost[0]["text"], lost[2]["text"]) == ("", 0, odd.where("doc_id = 0").first()["text"], None)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == [0, 1, 2, 3, 4, 5, 6, 7, 8, None]
    tokens = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert [tokens[d] for d in (1, 2, 3)] == [0, 0, 0] and all(tokens[d] for d in (None, 0, 4, 5, 6, 7, 8))


def test_empty_table(spark, none, tmp_path):
    sf = tables(spark, tmp_path / "none", none, [])
    assert corpus_pipeline.run(spark, sf).collect() == []
