"""Discovering and classifying the files of a source tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default patterns. Fixed values.
SOURCE_GLOBS = "*.py *.js *.jsx *.ts *.tsx *.mjs *.cjs *.java *.go *.rs *.c *.cc *.cpp *.h *.hpp *.hxx *.cs *.scala *.kt *.rb *.php".split()
DOC_GLOBS = "*.md *.mdx *.rst *.txt".split()
CONFIG_GLOBS = "*.json *.yaml *.yml *.toml *.ini *.cfg".split()
EXCLUDE_GLOBS = ".git .venv venv node_modules __pycache__ build dist .pytest_cache .mypy_cache .ruff_cache coverage egg-info .tox .eggs .cache".split()
MAX_BYTES = 1_000_000
#: Bytes in which a NUL makes a file binary.
PROBE = 8192
#: Tasks that list folders, for each core.
LISTING = 4

#: Endings of each language. Fixed values.
LANGUAGES = {
    "python": [".py", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cc", ".cpp", ".cxx", ".hpp", ".hxx", ".hh"],
    "csharp": [".cs"],
}


@dataclass
class Discovery:
    source: list[str] = field(default_factory=lambda: list(SOURCE_GLOBS))
    doc: list[str] = field(default_factory=lambda: list(DOC_GLOBS))
    config: list[str] = field(default_factory=lambda: list(CONFIG_GLOBS))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE_GLOBS))
    max_bytes: int = MAX_BYTES


def glob_regex(globs: list[str]) -> str:
    """A pattern that matches a whole name if any of the globs does."""
    specials = {"*": ".*", "?": "."}
    return "^(?:" + "|".join("".join(specials.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in g) for g in globs) + ")$" if globs else "^\\b$"


def excluded(path: Column, globs: list[str] | None = None) -> Column:
    """Whether any component of a path, its name included, matches an exclude pattern."""
    pattern = F.lit(glob_regex(EXCLUDE_GLOBS if globs is None else globs))
    return F.exists(F.split(path, "/"), lambda p: F.rlike(p, pattern))


def kind_of(path: Column, config: Discovery | None = None) -> Column:
    """"doc", "config" or "source", the first that fits the file's name; else null."""
    c = config or Discovery()
    name = F.substring_index(path, "/", -1)
    test = lambda globs: F.rlike(name, F.lit(glob_regex(globs)))
    return F.when(test(c.doc), "doc").when(test(c.config), "config").when(test(c.source), "source")


def language_of(path: Column) -> Column:
    """The language of a path's ending, in any case; else null."""
    low, out = F.lower(path), None
    for language, endings in LANGUAGES.items():
        test = F.rlike(low, F.lit("(?:" + "|".join("\\" + e for e in endings) + ")$"))
        out = F.when(test, language) if out is None else out.when(test, language)
    return out


def read_text(content: Column, most: int = MAX_BYTES) -> Column:
    """The first bytes of a file as text; what is not UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(F.substring(content, 1, most).cast("string"))


def discover(spark: SparkSession, root: str, config: Discovery | None = None) -> DataFrame:
    """``path, rel_path, kind, language, size, skip_reason, text, line_count`` of every file that a kind fits.

    ``skip_reason`` is "too_large" or "binary" where the text was left out, else null. Excluded files give no row.
    """
    c = config or Discovery()
    base = root.rstrip("/")
    # a task lists many folders; by default there is one for each, of up to 10,000
    key, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTING * spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), tasks)))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    finally:
        spark.conf.set(key, before)
    inner = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.substr(inner, F.length(F.lit(base.removeprefix("file://"))) + 2) if "://" not in base.removeprefix("file://") else F.substr("path", F.length(F.lit(base)) + 2)
    # contents of larger files are never read: the first scan filters by length, the second lists names and lengths alone
    small = files.where(F.col("length") <= c.max_bytes).select("path", rel.alias("rel_path"), F.col("length").alias("size"), "content")
    large = files.where(F.col("length") > c.max_bytes).select("path", rel.alias("rel_path"), F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"))
    listed = small.unionByName(large).where(~excluded(F.col("rel_path"), c.exclude))
    kinds = listed.withColumn("kind", kind_of(F.col("rel_path"), c)).where("kind is not null")
    binary = F.contains(F.substring("content", 1, PROBE), F.lit(b"\0"))
    reason = F.when(F.col("size") > c.max_bytes, "too_large").when(binary, "binary")
    out = kinds.withColumn("skip_reason", reason).withColumn("text", F.when(F.col("skip_reason").isNull(), read_text(F.col("content"), c.max_bytes)))
    return out.select("path", "rel_path", "kind", language_of(F.col("rel_path")).alias("language"), "size", "skip_reason", "text", line_count(F.col("text")).alias("line_count"))


def line_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0)).cast("int")


def sources(found: DataFrame, kind: str = "source") -> DataFrame:
    """The files of one kind that were read."""
    return found.where((F.col("kind") == kind) & F.col("skip_reason").isNull())
