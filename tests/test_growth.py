"""Steps that have to grow no faster than their tables."""

import random


def test_components_move_narrow_keys_and_each_edge_once(spark, sf, monkeypatch):
    """the graph's edges are written once, as whole numbers, and what follows is smaller."""
    from loomgraph.operators import community
    from loomgraph.plans import graph_view
    from loomgraph.plans.queries import QUERIES

    kinds, rows = set(), []

    def kept(df, write=community._durable):
        kinds.update(f.dataType.simpleString() for f in df.schema)
        rows.append((out := write(df)).count())
        return out

    monkeypatch.setattr(community, "_durable", kept)
    got = QUERIES["connected_components"](spark, sf)
    assert got.count() == graph_view.vertices(spark, sf).count()
    edges = graph_view.key_edges(spark, sf, merged=False).count()
    assert kinds <= {"bigint", "boolean"} and rows[0] <= edges and max(rows[1:]) <= got.count()


def test_components_of_chains_loops_strays_and_repeats(spark):
    from loomgraph.operators.community import PAIRS, connected

    rng = random.Random(5)
    names = list(range(400))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[i], names[i]) for i in range(300, 310)] + [(rng.choice(names[200:280]), rng.choice(names[200:280])) for _ in range(60)]
    edges += edges[:20] + [(names[0], 9999), (9999, names[399])]
    parent = {x: x for x in names}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if 9999 not in (a, b):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    nodes = spark.createDataFrame([(x,) for x in names], "id long")
    table = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "source long, target long, weight double")
    assert {r["id"]: r["label"] for r in connected(nodes, table).collect()} == {x: top(x) for x in names}
    none = spark.createDataFrame([], "a long, b long, weight double").select(*PAIRS)
    assert {r["id"]: r["label"] for r in connected(nodes, none).collect()} == {x: x for x in names}


def test_hits_do_not_carry_their_texts(spark):
    """a text that holds many needles is not copied for each of them."""
    from loomgraph.operators.resolve import containing

    texts = spark.createDataFrame([(1, "ab abc b", "x"), (2, None, "y"), (3, "b", "z")], "doc int, body string, more string")
    needles = spark.createDataFrame([("ab", 1), ("b", 2), ("b", 3), ("", 4), ("q", 5)], "word string, n int")
    found = containing(texts, "body", needles, "word")
    assert sorted(found.columns) == ["doc", "more", "n", "word"]
    assert sorted((r["doc"], r["more"], r["n"]) for r in found.collect()) == [(1, "x", 1), (1, "x", 2), (1, "x", 3), (3, "z", 2), (3, "z", 3)]


def test_long_documents_of_the_tree_are_whole_units(spark, sf, tmp_path):
    """a document of more than a unit's characters is one whole unit, and documents need no graph."""
    import duckdb

    from loomgraph.plans import table_tree
    from loomgraph.plans.queries import ORACLES, QUERIES

    spark.range(1, 141).selectExpr("id AS s_suppkey", "0L AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 2").write.parquet(str(tmp_path / "nation.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = lambda found: sorted(tuple(r) for r in found)
    assert rows(QUERIES["index_documents"](spark, str(tmp_path)).collect()) == rows(con.execute(ORACLES["index_documents"]).fetchall())
    assert "entities" not in table_tree._begun(spark, str(tmp_path))
    got = rows(QUERIES["index_text_units"](spark, str(tmp_path)).collect())
    assert got == rows(con.execute(ORACLES["index_text_units"]).fetchall()) and max(len(r[1]) for r in got) > 2400


def test_files_are_parsed_once_and_in_slices(spark):
    """no function of columns that a plan repeats; more files than a slice has give all their facts."""
    from pyspark.sql import functions as F

    from loomgraph.sources import pyparse

    many = 2 * pyparse.SLICE + 1
    found = spark.range(many).coalesce(1).select(F.concat("id", F.lit(".py")).alias("rel_path"), F.lit("python").alias("language"), F.concat(F.lit("import m"), "id").alias("text"))
    parsed = pyparse.parse_files(found)
    assert parsed.columns == ["rel_path", "language", "text", "facts"]
    named = parsed.select("rel_path", F.explode("facts.imports").alias("i"))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    assert {(r["rel_path"], r["i"]["module"]) for r in named.collect()} == {(f"{i}.py", f"m{i}") for i in range(many)}


def test_best_rows_of_slices_are_those_of_all_rows_and_matrices_stay_small():
    """scores are held for a slice of rows, and a task gives k rows for each query whatever it reads."""
    import numpy as np
    import pyarrow as pa

    from loomgraph.operators import vector_index

    rng = np.random.default_rng(3)
    score, own = rng.integers(0, 9, (7, 500)) / 4, rng.permutation(500)
    for keys in (own, np.array([f"{x:03d}" for x in own])):
        best = vector_index.Best(7, 5)
        for i in range(0, 500, 33):
            best.take(np.arange(7), score[:, i : i + 33], keys[i : i + 33], cell=i)
        q, key, cell, s = best.rows()
        assert [(a, b, c) for a, b, c in zip(q, key, s)] == [(a, keys[j], score[a, j]) for a in range(7) for j in np.lexsort((own, -score[a]))[:5]]
        assert all(k in keys[c : c + 33] for k, c in zip(key, cell))
    batch = pa.RecordBatch.from_pydict({"key": list(range(10_000))})
    cut = list(vector_index.slices(batch, 2_000))
    assert sum(b.num_rows for b in cut) == 10_000 and max(b.num_rows for b in cut) * 2_000 <= vector_index.NUMBERS


def test_postings_are_made_in_the_tasks_that_read_the_units(spark, tmp_path, monkeypatch):
    """lists and not single places are shuffled; texts in many slices and parts give what their trigrams are."""
    from collections import defaultdict

    from loomgraph.operators import text_index

    rng = random.Random(7)
    texts = {rng.randrange(10**7): "".join(rng.choice(letters) for _ in range(rng.choice([0, 2, 3, 40, 700]))) for letters in ("ab", "xyz\0 é😀", [chr(0x4E00 + i) for i in range(9000)]) for _ in range(15)}
    want = defaultdict(set)
    for seq, text in texts.items():
        for i in range(len(text) - 2):
            want[text[i : i + 3]].add(seq)

    def found(rows):
        got = defaultdict(set)
        for gram, block, places in rows:
            assert places == sorted(set(places)) and places[-1] < 1000
            got[gram].update(block * 1000 + p for p in places)
        return got

    made = text_index._lists(list(texts), list(texts.values()), 1000).to_pylist()
    assert found((r["gram"], r["block"], r["places"]) for r in made) == want
    monkeypatch.setattr(text_index, "BLOCK", 1000)
    monkeypatch.setattr(text_index, "LETTERS", 100)
    text_index.write(spark.createDataFrame(list(texts.items()), "seq long, text string"), str(tmp_path / "index"))
    index = text_index.Index(spark, str(tmp_path / "index"))
    assert found((r["gram"], r["block"], r["places"]) for r in index.postings.collect()) == want
    for term in ("aba", "abbaab", "xyz", max(texts.values(), key=len)[95:107]):
        assert {r["seq"] for r in index.holding(term).collect()} == {seq for seq, text in texts.items() if term in text}


def test_tokens_are_counted_where_their_texts_are_read(spark, monkeypatch):
    """no row for each token is made, and long texts are cut between tokens only."""
    import hashlib

    from loomgraph.plans import embed

    long = "ab the a Äab_9 " * 50 + "q" * 300
    table = spark.createDataFrame([("x", "Äab, ab THE cd"), ("x", "cd"), ("y", None), ("z", ""), ("w", "the a"), ("v", long)], "name string, body string")
    at = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") % 384
    want = {("x", at("ab")): 2, ("x", at("cd")): 2, ("v", at("ab")): 50, ("v", at("ab_9")): 50, ("v", at("q" * 300)): 1}
    got = embed.bucket_counts(table, "name", "body")
    assert {(r["name"], r["bucket"]): r["n"] for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(embed, "PIECE", 7)
    assert sum(embed._Buckets(384).counts(long.lower().encode())) == 101 and len(set(want)) == 5


def test_degrees_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """what is made distinct is dealt by its number of rows, once."""
    from loomgraph.operators import merge

    monkeypatch.setattr(merge, "PAIRS", 100)
    rows = spark.range(2000).selectExpr("id % 50 AS source", "id % 40 AS target")
    got = merge.degrees(rows)
    want = {}
    for i in range(2000):
        a, b = i % 50, i % 40
        want.setdefault(a, set()).add(b)
        want.setdefault(b, set()).add(a)
    assert {r["id"]: r["degree"] for r in got.collect()} == {k: len(x) for k, x in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.strip().split("RepartitionByExpression")[1].split("\n")[0].strip().endswith("20")


def test_files_of_a_tree_are_written_by_many_tasks(spark, sf, tmp_path, monkeypatch):
    """F16: however few tasks read the pages, some write a file for each."""
    from collections import Counter

    import duckdb

    from loomgraph.plans import queries
    from loomgraph.sources import staging

    monkeypatch.setattr(queries, "_FILES", 20)
    monkeypatch.setattr(staging, "fresh", lambda spark, name: str(tmp_path / name))
    got = queries.QUERIES["discovered_files"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(queries.ORACLES["discovered_files"])
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
    tasks = Counter(p.name[:10] for p in (tmp_path / "tree").glob("part=*/page_id=*/part-*"))
    assert len(tasks) > 2 and sum(tasks.values()) == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_a_task_lists_many_folders(spark, tmp_path):
    """however many folders a tree has, they are listed by a few tasks for each core."""
    from loomgraph.sources import files

    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.py").write_text("x = 1\n")
    sc, key = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    sc.setJobGroup("listing", "listing")
    found = files.discover(spark, str(tmp_path))
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(x) for j in tracker.getJobIdsForGroup("listing") for x in tracker.getJobInfo(j).stageIds]
    assert stages and max(x.numTasks for x in stages) <= files.LISTING * sc.defaultParallelism < 60
    assert found.count() == 60 and spark.conf.get(key) == before


def test_the_sidecar_is_compressed_and_looks_up_no_title_twice(spark, tmp_path):
    """relations that bring their ends' titles are not joined with the entities."""
    from loomgraph.sources import tables

    entities = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "id string, title string, seq long")
    plain = spark.createDataFrame([("a", "b", 1), ("b", "x", 2)], "source string, target string, seq long")
    titled = spark.createDataFrame([("a", "b", "A", "B", 1), ("b", "x", "B", None, 2)], "source string, target string, source_title string, target_title string, seq long")
    assert "Join" not in tables.sidecar(entities, titled)._jdf.queryExecution().optimizedPlan().toString()
    for name, relations in (("plain", plain), ("titled", titled)):
        path = str(tmp_path / name)
        tables.write_sidecar(entities, relations, path)
        rows = tables.read_sidecar(spark, path, "relation", "source string, target string, source_title string, target_title string").collect()
        assert sorted(tuple(r) for r in rows) == [("a", "b", "A", "B", 1), ("b", "x", "B", None, 2)]
        assert {r["title"] for r in tables.read_sidecar(spark, path, "entity", "id string, title string").collect()} == {"A", "B"}
        files = list((tmp_path / name).glob("part=*/part-*"))
        assert files and all(f.name.endswith(".json.gz") for f in files)
