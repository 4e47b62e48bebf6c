"""The engine's functions by name in SQL: scalar ones as SQL functions, which Catalyst inlines, and table functions for LATERAL.

    register(spark)
    spark.sql("SELECT f.rel_path, d.* FROM files f, LATERAL source_facts(f.text, 'definitions') d")
    spark.sql("SELECT match_score(name, qualified_name, 'Engine') AS score FROM entities")

Table functions give no rows for null texts, for texts that do not parse, and for empty ones.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction
from pyspark.sql.functions import udtf

from ..shipping import ship
from .vectors import LOCAL_DIM, STOP_WORDS

#: Name, parameters, result and body of each scalar function. The bodies say what the column functions of ``identity`` and ``vectors`` do.
SCALARS = {
    "stable_id": ("kind STRING, repo STRING, file STRING, qualified_name STRING", "STRING", "substring(sha1(cast(kind || '|' || repo || '|' || file || '|' || qualified_name AS BINARY)), 1, 20)"),
    "location": (
        "file STRING, first BIGINT, last BIGINT", "STRING",
        "CASE WHEN coalesce(first, 0) > 0 AND last > first THEN file || ':' || first || '-' || last WHEN coalesce(first, 0) > 0 THEN file || ':' || first ELSE file END",
    ),
    "match_score": (
        "name STRING, qualified_name STRING, term STRING", "INT",
        """CASE WHEN lower(qualified_name) = lower(term) THEN 5 WHEN lower(name) = lower(term) THEN 4 WHEN endswith(lower(qualified_name), '.' || lower(term)) THEN 3
           WHEN contains(lower(term), lower(name)) OR contains(lower(qualified_name), lower(term)) THEN 1 ELSE 0 END""",
    ),
    "title_score": (
        "title STRING, term STRING", "INT",
        "CASE WHEN lower(title) = lower(term) THEN 5 WHEN substring_index(lower(title), '.', -1) = lower(term) THEN 4 WHEN contains(lower(title), lower(term)) THEN 2 ELSE 0 END",
    ),
    "token_count": ("text STRING", "INT", "greatest(1, cast(floor(length(text) / 3) AS INT))"),
    "hash_bucket": ("token STRING", "INT", f"cast(cast(conv(substring(md5(cast(token AS BINARY)), 1, 16), 16, 10) AS DECIMAL(20, 0)) % {LOCAL_DIM} AS INT)"),
}

#: Columns of each kind of fact. Definitions tell their number of parameters.
KINDS = {
    "definitions": "kind string, name string, qualified_name string, start_line int, end_line int, n_params int, signature string, docstring string",
    "calls": "callee string, is_method_call boolean, receiver string, line int",
    "imports": "module string, level int, symbols array<string>, originals array<string>, line int",
    "raises": "exception string, line int",
    "assignments": "name string, value_preview string, is_constant boolean, line int",
}
_FIELD = {"definitions": "defs", "assignments": "assigns"}


_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}


def _columns(listed: str) -> AnalyzeResult:
    """Columns by name and type; where a table function is analysed, there is no session that could read them."""
    schema = StructType()
    for name, kind in (x.split(" ") for x in listed.split(", ")):
        schema = schema.add(name, _TYPES[kind])
    return AnalyzeResult(schema=schema)


class SourceFacts:
    """``source_facts(text, kind)``: the facts of one kind of a Python file. kind is a constant, which decides the columns."""

    def __init__(self, analyzed: AnalyzeResult | None = None) -> None:
        self.names = [f.name for f in analyzed.schema] if analyzed else []

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(map(repr, KINDS))}")
        return _columns(KINDS[kind.value])

    def eval(self, text: str | None, kind: str) -> Iterator[tuple]:
        from ..sources.pyparse import facts

        for fact in facts(text)[_FIELD.get(kind, kind)] if text else ():
            yield tuple(len(fact["params"]) if n == "n_params" else fact[n] for n in self.names)


class EmbeddingBuckets:
    """``embedding_buckets(text, dimensions)``: how many tokens of a text fall into each bucket of the local embedding."""

    @staticmethod
    def analyze(text: AnalyzeArgument, dimensions: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _columns("bucket int, n bigint")

    def eval(self, text: str | None, dimensions: int = LOCAL_DIM) -> Iterator[tuple]:
        words = Counter(w for w in re.findall("[a-z0-9_]+", (text or "").lower()) if len(w) >= 2 and w not in STOP_WORDS)
        found: Counter = Counter()
        for word, n in words.items():
            found[int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big") % dimensions] += n
        yield from found.items()


TABLES: dict[str, type] = {"source_facts": SourceFacts, "embedding_buckets": EmbeddingBuckets}


def table_function(name: str) -> UserDefinedTableFunction:
    return udtf(TABLES[name], useArrow=False)


def register(spark: SparkSession) -> None:
    """Make all functions known to the session's SQL, in place of any of their names."""
    ship(spark)
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name in TABLES:
        spark.udtf.register(name, table_function(name))
