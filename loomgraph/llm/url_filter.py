"""URL rules by a sort-merge range join over reversed-host keys, with DataFrame functions only.

A rule is a host and a path prefix. Its key is the host's labels in reverse order, then the path, so that of one host's
keys the rule holds an interval: from the path's bytes up to those bytes with one above all bytes of UTF-8 behind them. A
url has one key for each suffix of its host, as a rule also fits all subdomains.

Each host's rules are swept in sorted order with a stack of those still open, kept by levels: the number of open rules
is a running sum, and what is open at a level is the last rule that opened there. This turns nested intervals into
boundaries that each carry the innermost open rule. Boundaries and url keys are then merged in sorted order, and each key
takes the rule of the last boundary before it; of a url's keys, that with the longest rule wins.

Only distinct pairs of host and path whose suffix some rule names are merged. A run is one reversed host; a host with
many keys is cut into salted runs, each of at least ``RUN_ROWS`` keys and of as many as the host has boundaries, so that
copies of boundaries never outnumber the keys. Any number of rules keeps as many runs as it has hosts.

Defined cases: a null url or one without "://" has an empty host and path and fits no rule; hosts keep ports and user
names; rules' hosts are lower-cased as urls' are, A-Z alone, and a null host, path or verdict of a rule is an empty one;
of rules with equal host and path the later counts, and of fitting rules of equal length that with the longer host;
repeated rows are judged each for itself; no rules: no row fits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Keys of a run of a host that has many, at least.
RUN_ROWS = 500_000
#: Hosts of rules that may be broadcast (some 50 bytes each); more are joined by shuffles.
BROADCAST_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z as lower case, and the path of urls."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3))
    host = lowered(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """``seq, host, path, verdict`` of a list of rules."""
    return spark.createDataFrame([(i, r.host, r.path, r.verdict) for i, r in enumerate(rules)], "seq long, host string, path string, verdict string")


def boundaries(rules: DataFrame) -> DataFrame:
    """``key, at, rule, verdict, host_length``: the places within each reversed host where the innermost open rule changes."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    once = rules.select(lowered(text("host")).alias("host"), text("path").alias("path"), text("verdict").alias("verdict"), "seq").groupBy("host", "path").agg(F.max_by("verdict", "seq").alias("verdict"))
    mark = F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"))
    start = F.col("path").cast("binary")
    events = once.select(_reversed(F.split("host", r"\.")).alias("key"), F.explode(F.array(
        F.struct(start.alias("at"), F.lit(1).alias("opens"), mark.alias("mark")),
        F.struct(F.concat(start, F.unhex(F.lit("FF"))).alias("at"), F.lit(-1).alias("opens"), F.lit(None).cast("struct<rule: string, verdict: string, host_length: int>").alias("mark")),
    )).alias("e")).select("key", "e.*")
    depth = F.sum("opens").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # at an end, what is still open around it opened last at the level that is left
    open_ = F.last("mark", ignorenulls=True).over(Window.partitionBy("key", "depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    levels = events.withColumn("depth", depth).withColumn("open", F.when(F.col("depth") > 0, open_))
    return levels.select("key", "at", "open.rule", "open.verdict", "open.host_length")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; default is the verdict where no rule fits.

    Rules are a list, or a table of seq, host, path and verdict.
    """
    spark = pages.sparkSession
    marks = written(boundaries(rule_table(spark, rules) if isinstance(rules, list) else rules), "boundaries")
    hosts = marks.groupBy("key").agg(F.count("*").alias("marks"))
    small = hosts.count() <= BROADCAST_HOSTS
    sent = F.broadcast if small else lambda df: df
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # all suffixes of the host, the whole one first
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _reversed(F.slice(labels, i, F.size(labels))))
    probes = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("key")).join(sent(hosts.select("key")), "key", "left_semi")
    probes = written(probes, "probes")
    counts = probes.groupBy("key").agg(F.count("*").alias("probes"))
    salts = counts.join(sent(hosts), "key").select("key", F.ceil(F.col("probes") / F.greatest(F.lit(RUN_ROWS), "marks")).alias("salts"))
    salts = written(salts, "salts")
    kept = probes.join(sent(salts), "key").select("key", F.pmod(F.xxhash64("host", "path"), "salts").alias("salt"), F.col("path").cast("binary").alias("at"), F.lit(True).alias("probe"), F.struct("host", "path").alias("url"), F.lit(None).cast("struct<rule: string, verdict: string, host_length: int>").alias("mark"))
    copies = marks.join(sent(salts), "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "at", F.lit(False).alias("probe"), F.lit(None).cast("struct<host: string, path: string>").alias("url"), F.struct("rule", "verdict", "host_length").alias("mark"))
    sweep = Window.partitionBy("key", "salt").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = kept.unionByName(copies).withColumn("mark", F.last("mark", ignorenulls=True).over(sweep)).where("probe and mark.rule is not null")
    best = F.max(F.struct(F.length("mark.rule").alias("n"), F.col("mark.host_length").alias("host_length"), F.col("mark.rule").alias("rule"), F.col("mark.verdict").alias("verdict")))
    chosen = written(found.groupBy("url.host", "url.path").agg(best.alias("best")), "chosen")
    forget(marks, probes, salts)
    out = urls.join(chosen.hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
