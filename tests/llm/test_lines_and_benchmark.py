import random
import re

import numpy as np
import pyarrow as pa

from loomgraph.llm import decontaminate, line_dedup
from loomgraph.llm.queries import QUERIES


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distance():
    rng = random.Random(1)
    for _ in range(500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert decontaminate.distance(p, t, 1000)[0] == edit(p, t)


def test_edited_items_are_found_and_others_not(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(6, ""), (7, None), (8, "..."), (9, "tiny")]
    docs = []
    for n in range(60):
        chosen = items[n % 6][1]
        folded = decontaminate.fold(chosen)
        edits = rng.randrange(0, 2 * decontaminate.budget(len(folded)))
        text = list(chosen)
        for _ in range(edits):
            text[rng.randrange(len(text))] = rng.choice("abcdefghij ")
        docs.append((n, " ".join(word() for _ in range(50)) + " " + "".join(text).upper() + ", " + " ".join(word() for _ in range(50)), 1))
    docs += [(100, None, 1), (101, "", 1), (102, "a tiny, thing", 1), (103, "tinyer", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(df, table).collect()}
    want = {}
    for d, t, _ in docs:
        for i, x in items:
            p, f = decontaminate.fold(x), decontaminate.fold(t)
            if p and f and (n := edit(p, f)) <= decontaminate.budget(len(p)):
                want[d, i] = n
    assert got == want and (102, 9) in got and (103, 9) not in got
    kept = decontaminate.clean(df, table)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}


def test_benchmark_query(spark, sf):
    items = [(r["item_id"], decontaminate.fold(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {(r["doc_id"], i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, p in items if p in decontaminate.fold(r["text"])}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op1_decontamination"](spark, sf).collect()}
    assert exact <= set(got) and all(got[k] == 0 for k in exact)


def test_awkward_rows(spark, odd, none):
    table = spark.createDataFrame([(1, "repeated row with the same words twice in the table")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(odd, table).collect()] == [9, 9]
    assert decontaminate.contaminated(none, table).count() == 0 and decontaminate.contaminated(odd, table.limit(0)).count() == 0
    got = line_dedup.deduplicated(odd)
    assert got.columns == [*odd.columns, "removed_lines", "removed_words", "partners", "blocks"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == odd.count() and rows[1]["text"] == "" and rows[1]["partners"] == [0] and rows[2]["text"] is None
    assert all(r["text"] == o["text"] for o in odd.collect() if (r := rows[o["doc_id"]])["removed_lines"] == 0)
    assert line_dedup.deduplicated(none).count() == 0


def split(text):
    """A naive splitter: of each line where it begins, its bytes and its words."""
    out, open_, divides = [], None, True
    data = text + b"\n"
    for i, c in enumerate(data):
        before = data[i - 1 : i] or b"\n"
        if c in b" \t" and before not in (b" ", b"\t"):
            divides = before in (b"\n", b".", b"!", b"?")
        if c == 10 or c in b" \t" and divides:
            if open_ is not None:
                out.append((open_, data[open_:i], len(re.findall(rb"[^\x20\x09-\x0d]+", data[open_:i]))))
            open_ = None
        elif open_ is None:
            open_ = i
    return out


def brute(docs, block=line_dedup.BLOCK):
    """The lines that go: of every pair of documents, those in an unbroken common run of block words or more."""
    parts = {d: split(t.encode()) for d, t in docs}
    out = {d: set() for d in parts}
    for d in parts:
        own = [x for _, x, _ in parts[d]]
        for p in parts:
            if p >= d:
                continue
            places = {}
            for j, (_, x, _) in enumerate(parts[p]):
                places.setdefault(x, []).append(j)
            match = {(i, j) for i, x in enumerate(own) for j in places.get(x, ())}
            for i, j in match:
                if (i - 1, j - 1) not in match:
                    n = 0
                    while (i + n, j + n) in match:
                        n += 1
                    if sum(w for _, _, w in parts[d][i : i + n]) >= block:
                        out[d] |= set(range(i, i + n))
    return out


def left(text, gone):
    """The text without these lines and what follows each."""
    begin = [b for b, _, _ in split(text)]
    ends = [*begin[1:], len(text)]
    out = text[: begin[0]] + b"".join(text[b:e] for i, (b, e) in enumerate(zip(begin, ends)) if i not in gone) if begin else text
    return out.rstrip(b"\n\t ") if len(begin) - 1 in gone else out


def test_lines_against_a_naive_splitter(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab. !?\n\t\x0bé") for _ in range(rng.randrange(0, 80))).encode() for _ in range(200)] + [b"", b"x" * 300, b"a.  \t " * 60, b" " * 200]
    for size in (line_dedup.SLICE, 16):
        monkeypatch.setattr(line_dedup, "SLICE", size)
        begin, end, hashed, words, starts = line_dedup.lines(texts)
        for t, a, b in zip(texts, starts, starts[1:]):
            assert [(x, t[x:y], w) for x, y, w in zip(begin[a:b], end[a:b], words[a:b])] == split(t)
        seen = {}
        for t, a, b in zip(texts, starts, starts[1:]):
            for x, y, h in zip(begin[a:b], end[a:b], hashed[a:b]):
                assert seen.setdefault(t[x:y], h) == h
        assert len(set(seen.values())) == len(seen)


def test_line_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert sum(map(bool, want.values())) > 10
    words = {d: [w for _, _, w in split(t.encode())] for d, t in docs}
    for r in QUERIES["op10_line_dedup"](spark, sf).collect():
        d = r["doc_id"]
        assert r["removed_lines"] == len(want[d]) and r["text"].encode() == left(dict(docs)[d].encode(), want[d])
        assert r["removed_words"] == sum(words[d][i] for i in want[d]) and bool(r["partners"]) == bool(want[d])


def test_a_shared_passage_goes_from_later_documents(spark):
    passage = "This passage is shared by many documents, word for word. " + " ".join(f"shared{i}" for i in range(50)) + "."
    docs = [(i, f"Own beginning {i} of the text, unlike others.\n{passage} Own end number {i} stands here.", None) for i in range(20)]
    rows = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string, partners string")).collect()
    assert sum("shared7" in r["text"] for r in rows) == 1 and all(f"end number {r['doc_id']} " in r["text"] and f"beginning {r['doc_id']} " in r["text"] for r in rows)


def test_chains_ascend_and_the_first_is_longest():
    rng = random.Random(4)
    for _ in range(300):
        there = [rng.randrange(12) for _ in range(rng.randrange(25))]
        got = line_dedup.chains(there)
        for c in set(got):
            chain = [y for y, g in zip(there, got) if g == c]
            assert all(x < y for x, y in zip(chain, chain[1:]))
        best = [0] * len(there)
        for i, y in enumerate(there):
            best[i] = 1 + max([best[j] for j in range(i) if there[j] < y], default=0)
        assert got.count(0) == max(best, default=0)
    assert line_dedup.chains(list(range(30))) == [0] * 30 and len(set(line_dedup.chains(list(range(30, 0, -1))))) == 30


def test_copies_of_short_lines_alone_go(spark):
    rng = random.Random(5)
    verse = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(rng.randint(1, 5))) for _ in range(60)]
    letters = " ".join(f"{rng.choice('ERWHDA')}{rng.choice('ERWHDA')}.!!" for _ in range(155))
    texts = ["\n".join(verse), letters, "\n".join(verse), letters, "My own words come first here.\n" + "\n".join(verse[20:40]) + "\nand last", "\n".join(verse[:3])]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["text"] for i in (0, 1, 5)] == [texts[i] for i in (0, 1, 5)]
    assert rows[2]["text"] == rows[3]["text"] == "" and rows[2]["partners"] == [0] and rows[3]["partners"] == [1]
    assert rows[4]["text"] == "My own words come first here.\nand last" and rows[4]["removed_lines"] == 20


def test_every_run_that_an_earlier_document_has_goes(spark):
    rng = random.Random(6)
    passage = lambda name, n, k: [" ".join(f"{name}{i}w{x}" for x in range(k)) + "." for i in range(n)]
    p, q, r, own = passage("p", 4, 8), passage("q", 4, 8), passage("r", 9, 3), lambda d, n: passage(f"own{d}x{n}", 2, 7)
    texts = [
        p + own(0, 0) + p, own(1, 0) + p + own(1, 1), own(2, 0) + p + own(2, 1) + p,  # the first holder has it twice
        q + own(3, 0), own(4, 0) + q + own(4, 1) + q + own(4, 2),  # the later one has it twice
        r + q, q + own(6, 0) + r, p + r + q, q + r + p,  # another order
        ["a line that is long enough to hold twenty words by itself as it goes on and on until its very end."] + own(9, 0),
        ["a line that is long enough to hold twenty words by itself as it goes on and on until its very end.", "short tail here."] + own(10, 0),
        own(11, 0) + ["a line that is long enough to hold twenty words by itself as it goes on and on until its very end.", "short tail here."],
    ]
    few = [" ".join(f"v{i}w{x}" for x in range(n)) + "." for i, n in enumerate((1, 2, 3, 4, 7, 11, 21, 5, 6, 1))]
    texts += [[few[rng.randrange(len(few))] for _ in range(rng.randrange(1, 25))] for _ in range(40)]
    docs = [(d, "\n".join(t)) for d, t in enumerate(texts)]
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rare in (0, 3, line_dedup.RARE):
        found = {x["doc_id"]: x["blocks"] for x in line_dedup.aligned(df, rare=rare).collect()}
        assert {d: set(line_dedup.gone(found.get(d, []))) for d, _ in docs} == want
        held = {d: [x for _, x, _ in split(t.encode())] for d, t in docs}
        words = {d: [w for _, _, w in split(t.encode())] for d, t in docs}
        for d, blocks in found.items():
            for b in blocks:
                # every block lies unbroken in its partner, and has enough words by itself
                n = b["end"] - b["begin"]
                assert b["partner"] < d and held[d][b["begin"] : b["end"]] == held[b["partner"]][b["there"] : b["there"] + n]
                assert sum(words[d][b["begin"] : b["end"]]) >= line_dedup.BLOCK


def aligned_blocks(spark, texts):
    rows = line_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return {r["doc_id"]: [tuple(b) for b in r["blocks"]] for r in rows}


def test_blocks_are_those_of_the_alignment(spark, monkeypatch):
    """What is deleted, block by block: a chain's neighbours are one block, what lies off the chain is another."""
    part = lambda name, n: [" ".join(f"{name}{i}w{x}" for x in range(22)) + "." for i in range(n)]
    a, b, c, own = part("a", 6), part("b", 3), part("c", 4), part("own", 1)
    texts = ["\n".join(t) for t in (a + b + c, b, a + own + b + c, c + a, a[:3] + own + a[3:] + a[:2])]
    want = {
        0: [], 1: [(0, 3, 0, 6)],
        # the passages of b are nearer in document 1, but the block over b and c ends with c in document 0
        2: [(0, 6, 0, 0), (7, 10, 1, 0), (10, 14, 0, 9)],
        3: [(0, 4, 2, 10), (4, 10, 2, 0)],
    }
    got = aligned_blocks(spark, texts)
    assert {d: got[d] for d in want} == want
    # the line between comes from document 2, and the repeated beginning is off the longest chain
    assert got[4] == [(0, 3, 3, 4), (3, 4, 2, 6), (4, 7, 3, 7), (7, 9, 3, 4)]
    # one chain for each passage instead of patience diff: no block is put together
    monkeypatch.setattr(line_dedup, "chains", lambda there: list(range(len(there))))
    table = pa.table({"doc_id": [9] * 6, "version": [0] * 6, "partner": [1] * 6, "begin": range(6), "end": range(1, 7), "there": [3, 4, 5, 0, 1, 2]}, schema=pa.schema([(n, pa.int64() if n in ("doc_id", "version", "partner") else pa.int32()) for n in ("doc_id", "version", "partner", "begin", "end", "there")]))
    assert len(line_dedup._blocks(table).column(2)[0]) == 6
    monkeypatch.undo()
    assert [tuple(x.values()) for x in line_dedup._blocks(table).column(2)[0].as_py()] == [(0, 3, 1, 3), (3, 6, 1, 0)]


def test_longer_blocks_win_and_none_lies_within_others():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 15)
        doc = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        begin = np.array([rng.randrange(20) for _ in range(n)])
        end, partner = begin + np.array([rng.randrange(1, 9) for _ in range(n)]), np.array([rng.randrange(4) for _ in range(n)])
        kept = line_dedup.chosen(doc, np.zeros(n, int), begin, end, partner)
        lines = lambda some: {(doc[i], x) for i in some for x in range(begin[i], end[i])}  # noqa: B023, E731
        assert lines(kept) == lines(range(n))
        for i in kept:
            longer = [j for j in kept if j != i and doc[j] == doc[i] and (end[j] - begin[j]) > (end[i] - begin[i])]
            assert not lines([i]) <= lines(longer)


def test_blocks_are_measured_within_one_partner(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n)) + "."
    shared, ten = line("l", 12), [line(f"s{i}x", 4) for i in range(10)]
    texts = [shared, "\n".join([shared, *ten]), "\n".join([shared, *ten])]
    # three lines, each of another earlier document, are no block of any
    texts += [line("a", 9), line("b", 9), line("c", 9), "\n".join([line("a", 9), line("b", 9), line("c", 9)])]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["text"] for i in (0, 1, 3, 4, 5, 6)] == [texts[i] for i in (0, 1, 3, 4, 5, 6)]
    assert rows[2]["text"] == "" and rows[2]["partners"] == [1]


def test_clashing_columns_and_shuffled_documents(spark, monkeypatch):
    line = " ".join(f"w{i}" for i in range(30)) + "."
    rows = [(0, line, 5, "x", 1, 2, 3, 4, 5, 6), (1, line, 6, "y", 1, 2, 3, 4, 5, 6), (1, line, 7, "y", 1, 2, 3, 4, 5, 6), (1, "another version", 8, "z", 1, 2, 3, 4, 5, 6), (None, line, 9, "n", 1, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed_lines int, partners string, _gone int, _doc int, doc int, version int, blocks int, row int")
    for most in (line_dedup.BROADCAST_LINES, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        got = line_dedup.deduplicated(df)
        assert got.columns == [*df.columns, "removed_lines_", "removed_words", "partners_", "blocks_"] == [*df.columns, *line_dedup.report_names(df.columns)]
        found = sorted(got.collect(), key=lambda r: r["removed_lines"])
        assert [(r["text"], r["removed_lines_"]) for r in found] == [(line, 0), ("", 1), ("", 1), ("another version", 0), (line, 0)]
        assert all(tuple(r)[2:10] == o[2:] for r, o in zip(found, rows))


def test_benchmark_in_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 4000)
    assert len(list(decontaminate.blocks(items))) > 2
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == want


def test_repetitive_text_takes_little_time_and_memory(monkeypatch):
    import time
    import tracemalloc

    item = "ha " * 20 + "ho " + "ha " * 20
    matcher = decontaminate.Matcher([(1, item)])

    def took(n):
        began = time.perf_counter()
        assert [(i, d) for i, d, *_ in matcher.matches("ha " * n)] == [(1, 1)]
        return time.perf_counter() - began

    small, large = took(30_000), took(300_000)
    assert large < 25 * small
    text = "ha " * 60_000
    monkeypatch.setattr(decontaminate, "SLICE", 4096)
    tracemalloc.start()
    matcher.matches(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)


def test_slices_of_a_text_fold_as_the_whole(monkeypatch):
    texts = ["", "  ", "Ab, cd!e  f\n\n g", "x" * 50, ". .. é É 中 " * 9, None]
    whole = [decontaminate.fold(t) for t in texts]
    monkeypatch.setattr(decontaminate, "SLICE", 3)
    assert [decontaminate.fold(t) for t in texts] == whole and whole[2] == " ab cd e f g "


def test_every_place_is_verified_as_by_single_hits():
    """Random texts over few words, where ranges of starts merge: the least distance is that over the whole text."""
    rng = random.Random(9)
    words = ["ab", "abc", "b", "ca", "bca"]
    for _ in range(150):
        item = " ".join(rng.choice(words) for _ in range(rng.randint(8, 25)))
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.7:
            at = rng.randrange(len(text))
            text = text[:at] + " " + edited(rng, item, rng.randint(0, 4)) + " " + text[at:]
        folded, whole = decontaminate.fold(item), decontaminate.fold(text)
        most = decontaminate.budget(len(folded))
        want, got = edit(folded, whole), decontaminate.Matcher([(1, item)]).matches(text)
        assert [d for _, d, *_ in got] == ([want] if want <= most else []), (item, text)


def edited(rng, text, times):
    for _ in range(times):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", text[i] + "y"]) + text[i + 1 :]
    return text
