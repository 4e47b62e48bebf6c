"""Identities and renderings of entities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(kind: Column, repo: Column, file: Column, qualified_name: Column) -> Column:
    """Twenty hex digits that depend on the four parts alone; null if any is null."""
    return F.substring(F.sha1(F.concat(kind, F.lit("|"), repo, F.lit("|"), file, F.lit("|"), qualified_name).cast("binary")), 1, 20)


def location(file: Column, start: Column, end: Column) -> Column:
    """``file:a-b``, ``file:a`` for one line, or the file alone where no line is known (0 or null)."""
    known = F.coalesce(start, F.lit(0)) > 0
    return F.when(known & (end > start), F.concat(file, F.lit(":"), start, F.lit("-"), end)).when(known, F.concat(file, F.lit(":"), start)).otherwise(file)


def match_score(name: Column, qualified_name: Column, term: Column) -> Column:
    """How well an entity fits a term, by lower case: 5, 4, 3, 1 or 0."""
    n, q, t = F.lower(name), F.lower(qualified_name), F.lower(term)
    return (
        F.when(q == t, 5).when(n == t, 4).when(F.endswith(q, F.concat(F.lit("."), t)), 3)
        .when(F.contains(t, n) | F.contains(q, t), 1).otherwise(0)
    )


def title_score(title: Column, term: Column) -> Column:
    """How well a title fits a term: 5 equal, 4 its last dotted part, 2 a part of it, 0."""
    t, x = F.lower(title), F.lower(term)
    return F.when(t == x, 5).when(F.element_at(F.split(t, r"\."), -1) == x, 4).when(F.contains(t, x), 2).otherwise(0)


def token_count(text: Column) -> Column:
    """The estimate of a text's tokens: a third of its characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def unit_header(file: Column, language: Column, kind: Column, start: Column, end: Column) -> Column:
    """``[file: ..] [language: ..] [type: ..] [lines: a-b]`` and a line end; language and lines only where known."""
    lines = F.when(F.coalesce(start, F.lit(0)) > 0, F.when(end > start, F.concat(start, F.lit("-"), end)).otherwise(start.cast("string")))
    bracket = lambda label, value: F.concat(F.lit(f"[{label}: "), value, F.lit("]"))
    spoken = F.when(F.coalesce(language, F.lit("")) != "", language)
    return F.concat(F.concat_ws(" ", bracket("file", file), bracket("language", spoken), bracket("type", kind), bracket("lines", lines)), F.lit("\n"))


def header_fields(text: Column) -> Column:
    """A struct of file, start and end as :func:`unit_header` wrote them; null where a part, or a range, is missing."""
    some = lambda x: F.when(x != "", x)
    return F.struct(
        some(F.regexp_extract(text, r"\[file: ([^\]]+)\]", 1)).alias("file"),
        some(F.regexp_extract(text, r"\[lines: (\d+)-(\d+)\]", 1)).cast("int").alias("start_line"),
        some(F.regexp_extract(text, r"\[lines: (\d+)-(\d+)\]", 2)).cast("int").alias("end_line"),
    )


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of the trimmed term, both in lower case; 0 for an empty term."""
    t, x = F.lower(text), F.lower(F.trim(term))
    return F.when(F.length(x) > 0, ((F.length(t) - F.length(F.replace(t, x, F.lit("")))) / F.length(x)).cast("int")).otherwise(0)


def evidence_key(kind: Column, title: Column, content: Column) -> Column:
    """What makes two pieces of evidence the same: kind, trimmed lower-case title and a digest of the content."""
    return F.concat(kind, F.lit(":"), F.lower(F.trim(title)), F.lit(":"), F.substring(F.md5(content.cast("binary")), 1, 10))
