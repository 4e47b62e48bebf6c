"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text is a multiset of paragraphs (its lines), and each paragraph one of pieces of up to eight words. Every paragraph
is hashed to ``WIDE`` words that are summed modulo 2**32, every piece to ``SIGNS`` bits that are summed modulo 2**32 as
well. Each pair of words comes from a hash of the whole paragraph with a seed of its own, so that paragraphs that collide
under one seed do not under the others. Sums do not depend on the order of paragraphs, and the sums of a text with a paragraph put in or taken out are
the old sums plus or minus that paragraph's vector, see :func:`combined`.

The wide words tell unequal multisets apart. The bit sums are a linear sketch: with n pieces, 2 * sum - n is a sum of
signs, so the mean product of two texts' sign sums estimates the pieces they have in common, and twice that over the
sum of their mean squares is their likeness.

Defined cases: a null text is an empty one, one empty paragraph without pieces; two texts without pieces have likeness
1 if their fingerprints are equal, else 0; rows of one doc_id follow each other by the hash of their text, the largest
first; a table of one row has that row for its own next document, and so has each row without doc_id; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

#: 32-bit words hashed from each paragraph.
WIDE = 8
#: Bits hashed from each piece; a multiple of 64.
SIGNS = 128
#: Runs of neighbouring documents, at least; the ids at their ends go through the driver.
RUNS = 512
#: Rows of a run, and runs made on their account at most: a row's run is found by some 2 * sqrt(runs) comparisons.
RUN_ROWS, MOST_RUNS = 20_000, 65_536
#: Rows of a run from which on a doc_id that fills several is cut.
HOT_ROWS = 1000
#: Words of a piece.
PIECE = r"[^\S\n]*(?:\S+[^\S\n]*){1,8}"
_LOW = 0xFFFFFFFF
_PAIR = 0x0000000100000001


def _lanes(paragraph: Column, piece: Column) -> list[Column]:
    """The vector of one element; a paragraph has no signs and a piece no wide words. Two 32-bit lanes to a long where both stay small."""
    # what comes first in xxhash64 seeds the hash of what follows
    wide = []
    for k in range(WIDE // 2):
        h = F.xxhash64(F.lit(k), paragraph)
        wide += [h.bitwiseAND(_LOW), F.shiftrightunsigned(h, 32)]
    out = [F.sum(F.when(paragraph.isNotNull(), x).otherwise(F.lit(0))) for x in wide]
    for k in range(SIGNS // 64):
        h = F.xxhash64(F.lit(100 + k), piece)
        out += [F.sum(F.when(piece.isNotNull(), F.shiftrightunsigned(h, i).bitwiseAND(_PAIR)).otherwise(F.lit(0))) for i in range(32)]
    return out + [F.count(piece)]


def _elements(text: Column) -> Column:
    """Of a text: structs of a paragraph or a piece, the other null."""
    paragraphs = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("paragraph"), F.lit(None).cast("string").alias("piece")))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: F.struct(F.lit(None).cast("string").alias("paragraph"), F.rtrim(x).alias("piece")))
    return F.concat(paragraphs, pieces)


def _packed(lanes: list[Column]) -> list[Column]:
    wide = [x.bitwiseAND(_LOW) for x in lanes[:WIDE]]
    signs = lanes[WIDE:-1]
    split = [x.bitwiseAND(_LOW) for x in signs] + [F.shiftrightunsigned(x, 32) for x in signs]
    return wide + split + [lanes[-1].bitwiseAND(_LOW)]


def fingerprints(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``vector`` (array of WIDE + SIGNS + 1 longs below 2**32, the last one the number of pieces) for each group of keys."""
    exploded = df.select(*keys, F.explode(_elements(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("e"))
    lanes = _lanes(F.col("e.paragraph"), F.col("e.piece"))
    names = [f"lane{i}" for i in range(len(lanes))]
    summed = exploded.groupBy(*keys).agg(*[x.alias(n) for x, n in zip(lanes, names)])
    return summed.select(*keys, F.array(*_packed([F.col(n) for n in names])).alias("vector"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets put together, or with sign -1 of the first without the second."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(_LOW))


def rendered(vector: Column) -> Column:
    """A vector as lowercase hex: the wide words, then a digest of the whole vector."""
    wide = F.array_join(F.transform(F.slice(vector, 1, WIDE), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    return F.concat(wide, F.substring(F.sha2(F.array_join(vector, ",").cast("binary"), 256), 1, 32))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the estimated share of pieces that two fingerprints have in common."""
    signs = lambda v: F.transform(F.slice(v, WIDE + 1, SIGNS), lambda x: 2 * x - v[WIDE + SIGNS])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    sa, sb = signs(a), signs(b)
    whole = dot(sa, sa) + dot(sb, sb)
    return F.when(a == b, 1.0).when(whole == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * dot(sa, sb) / whole)))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, and that of its text with the second half replaced by the beginning of the next document's.

    The next document is that of the next smaller doc_id; after the smallest comes the largest. Documents are dealt once,
    into runs of neighbouring ids; the document at the upper end of a run also goes to the run above as its last one's
    next. There are more runs where there are more rows or partitions. A doc_id that fills several runs is dealt into them
    by ranges of its texts' hashes. Rows without doc_id are spread over all runs, each its own next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    many = docs.count()
    runs = max(RUNS, 4 * parts(docs.sparkSession), min(MOST_RUNS, many // RUN_ROWS))
    ends = rows.agg(F.percentile_approx("key", [i / runs for i in range(1, runs)], min(20 * runs, 1_000_000)), F.max("key")).first()
    each = [*(ends[0] or []), *([ends[1]] if ends[1] is not None else [])]
    bounds = sorted(set(each))
    # a doc_id that is the end of several large runs fills them: into how many its rows are cut
    times = {v: each.count(v) for v in bounds} if many // runs >= HOT_ROWS else {}
    cuts = {v: n for v, n in times.items() if n > 1}
    own_runs: dict[int, list] = {v: [] for v in cuts}
    hot = F.col("key").isin(list(cuts)) if cuts else F.lit(False)
    part = _part(F.col("hash"), F.try_element_at(F.create_map(*[F.lit(x).cast("long") for v in cuts.items() for x in v]), F.col("key"))) if cuts else F.lit(0)
    if cuts:
        for t in rows.where(hot).groupBy("key", part.alias("part")).agg(F.max("hash").alias("hash")).orderBy("key", "part").collect():
            own_runs[t["key"]].append((t["part"], t["hash"]))
    first, total = [], 0
    for v in bounds:
        first.append(total)
        total += len(own_runs.get(v, ())) or 1
    run = F.get(_longs(first), _run(F.col("key"), bounds).cast("int"))
    at_end = F.array_contains(_longs([v for v in bounds if v not in cuts]), F.col("key"))
    if cuts:
        filled = F.create_map(*[x for v, ps in own_runs.items() for x in (F.lit(v).cast("long"), _longs([p for p, _ in ps]))])
        run = run + F.when(hot, F.array_position(F.try_element_at(filled, F.col("key")), part.cast("long")) - 1).otherwise(0)
        ends = F.array(*[F.struct(F.lit(v).cast("long").alias("key"), F.lit(h).cast("long").alias("hash")) for v, ps in own_runs.items() for _, h in ps])
        at_end = at_end | (hot & F.array_contains(ends, F.struct("key", "hash")))
    own, guest = F.struct(run.alias("run"), F.lit(False).alias("guest")), F.struct(F.when(run == total - 1, F.lit(0).cast("long")).otherwise(run + 1).alias("run"), F.lit(True).alias("guest"))
    alone = F.struct((-1 - F.pmod("salt", F.lit(runs))).cast("long").alias("run"), F.lit(False).alias("guest"))
    dealt = rows.withColumn("place", F.explode(F.when(F.col("key").isNull(), F.array(alone)).when(at_end, F.array(own, guest)).otherwise(F.array(own))))
    return _within(dealt.select("place.run", "key", "doc_id", "text", "hash", "place.guest"))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")


def _part(hash_: Column, many: Column) -> Column:
    """Which of ``many`` equal ranges of signed 64-bit hashes, from the smallest on."""
    return F.least(many - 1, F.floor((hash_ / F.lit(2.0**64) + 0.5) * many).cast("long"))


def _run(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below key, found in two steps of the square root of their number; null for null."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    outer = F.size(F.filter(_longs([b[-1] for b in blocks]), lambda b: b < key))
    inner = F.size(F.filter(F.try_element_at(F.array(*[_longs(b) for b in blocks]).cast("array<array<long>>"), outer + 1), lambda b: b < key))
    return F.when(key.isNotNull(), outer * step + inner)


def _within(dealt: DataFrame) -> DataFrame:
    order = Window.partitionBy("run").orderBy(F.col("guest"), F.desc("key"), F.desc("hash"), "text")
    following = F.when(F.col("key").isNull(), F.col("text")).otherwise(F.coalesce(F.lead("text").over(order), F.first("text").over(order)))
    numbered = dealt.withColumn("place", F.row_number().over(order)).withColumn("following", following)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.expr("left(following, int(floor(length(text) / 2)))"))
    both = numbered.select("run", "place", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.when(~F.col("guest"), edited).cast("binary"), 256).alias("sha"), F.when(half >= 0, edited).alias("edited"), "text")
    keys = ["run", "place", "guest", "doc_id", "n_chars", "sha", "kind"]
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("k")
    vectors = fingerprints(both.select(*keys[:-1], kinds).select(*keys[:-1], F.col("k.kind").alias("kind"), F.col("k.body").alias("body")).where("kind = 0 or not guest"), "body", keys)
    after = Window.partitionBy("run").orderBy("place", "kind")
    lined = vectors.select("*", F.lead("vector", 1).over(after).alias("changed"), F.when(F.col("run") < 0, F.col("vector")).otherwise(F.coalesce(F.lead("vector", 2).over(after), F.first("vector").over(after))).alias("next")).where("kind = 0 and not guest")
    return lined.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), rendered(F.col("vector")).alias("fingerprint"), rendered(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("changed")).alias("near_edited"), likeness(F.col("vector"), F.col("next")).alias("near_next"),
    )


__all__ = ["combined", "edited_fingerprints", "fingerprints", "likeness", "rendered"]
