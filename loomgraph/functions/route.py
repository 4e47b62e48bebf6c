"""Questions to query modes, question types and symbols, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deterministic modes in order of trial; each a list of groups, of every one of which a word must occur. Fixed values.
MODES: list[tuple[str, list[list[str]]]] = [
    ("path", [["path", "chain"], ["call"]]),
    ("path", [["from"], ["to"]]),
    ("callers", [["caller", "callers", "used by", "invokes it", "calls it"]]),
    ("callees", [["callee", "callees"]]),
    ("callees", [["call", "calls"], ["what", "which", "does it"]]),
    ("imported_by", [["imported by", "who imports", "what imports", "who import", "what import"]]),
    ("imports", [["import", "imports", "depends on", "dependencies", "depend on"]]),
    ("inherits", [["inherit", "inheritance", "inherits", "inherited", "subclass", "subclasses", "extends", "derived from"]]),
    ("where", [["where", "implemented", "defined", "located", "declaration"]]),
    ("config", [["config", "configuration"], ["affect", "affects", "impact", "impacted", "code"]]),
    ("files", [["file", "files"], ["involve", "involved", "related", "which", "touch", "touched"]]),
]

#: Words that are no symbols in a question. Fixed values.
STOP_WORDS = """
where is are the a an implemented implement defined located callers callees caller callee of what does do it calls which
import imports imported who by inherit inheritance inherits from to config configuration affects impact file files
involved related touch this that code function class method module api cli command main path chain depends on for with
when how why explain
""".split()

#: Question types in order of trial, and their patterns. Fixed values.
TYPES: list[tuple[str, str]] = [
    ("callers", r"\b(callers?|who calls|which (?:cli )?command|calls? (?:this|it))\b|谁调?用|被谁调用|调用方"),
    ("callees", r"\b(callees?|calls? (?:what|which)|does .{0,40} call)\b|调用(了|哪些|什么)"),
    ("module_dependency", r"\b(imports?|depend|depends on|dependencies|requires)\b|依赖(哪些|了|什么)?|引用了"),
    ("inheritance", r"\b(inherit\w*|subclass\w*|extends?\b|derived from|superclass)\b|继承"),
    ("call_path", r"\b(call (?:path|chain)|from \w+ (?:to|via) \w+)\b|调用链|调用路径"),
    ("config_impact", r"\b(config(?:uration)? (?:affect|impact)|impact of (?:modifying|changing)|what code is affected)\b|配置.{0,10}影响|修改.{0,30}影响|影响哪些代码"),
    ("documentation", r"\b(doc(?:umentation)?|readme|where is .{0,40} documented|official)\b|文档|说明书"),
    ("code_location", r"\b(where|defined|implemented|located|declared|in which file)\b|在哪|定义在|实现在|实现位置|哪个文件|哪里"),
    ("architecture", r"\b(architecture|overall|end to end|end-to-end|how (?:is|does) .{0,40} (?:work|build|structured))\b|架构|整体|流程|工作原理"),
    ("feature_explanation", r"\b(how (?:does|do|is)|what does|why|explain|describe)\b|是什么|干什么|作用"),
]

#: Words that are no symbols to the question analysis. Fixed values.
ANALYSIS_STOP_WORDS = """
the a an of in on for and or to is are was with by it this that as be do does did what which who how why when where file
line function class method module code command cli repo
""".split()

#: What to look at first for each question type.
HINTS = {
    "callers": "find the symbol, then list its callers",
    "callees": "find the symbol, then list its callees",
    "module_dependency": "list the imports of the module and who imports it",
    "inheritance": "list base classes and subclasses",
    "call_path": "find both ends, then the relations between them",
    "config_impact": "find the key, then what reads it",
    "documentation": "search the documentation",
    "code_location": "find the symbol and fetch its source",
    "architecture": "start from a global search, then an overview",
    "feature_explanation": "start from a local search, then fetch sources",
}

SEMANTIC_MODES = ["local", "global", "drift", "basic"]


def _has(question: Column, words: list[str]) -> Column:
    return F.rlike(question, F.lit(r"\b(" + "|".join(words) + r")\b"))


def mode(question: Column) -> Column:
    """The deterministic mode of a question, or null."""
    q, out = F.lower(question), None
    for name, groups in MODES:
        test = None
        for group in groups:
            one = _has(q, group)
            test = one if test is None else test & one
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _tokens(question: Column, pattern: str) -> Column:
    return F.regexp_extract_all(question, F.lit(pattern), F.lit(0))


def symbol(question: Column) -> Column:
    """The likeliest symbol: a quoted name, else the first code-like word, else the first word that is none of the common ones."""
    quoted = F.regexp_extract(question, "[\"'`]([A-Za-z_][A-Za-z0-9_.]*)[\"'`]", 1)
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.filter(_tokens(question, "[A-Za-z_][A-Za-z0-9_.]*"), lambda t: ~F.array_contains(stop, F.lower(t)))
    code = F.filter(words, lambda t: F.rlike(t, F.lit("[A-Z_]")))
    bare = F.trim(F.regexp_replace(F.trim(question), r"\?+$", ""))
    return F.coalesce(F.when(quoted != "", quoted), F.try_element_at(code, F.lit(1)), F.try_element_at(words, F.lit(1)), bare)


def path_symbols(question: Column) -> Column:
    """A struct of source and target of a call path; empty where they can't be told."""
    pattern = r"(?i)from\s+([A-Za-z_][A-Za-z0-9_.]*)\s+.*?\bto\s+([A-Za-z_][A-Za-z0-9_.]*)"
    a, b = F.regexp_extract(question, pattern, 1), F.regexp_extract(question, pattern, 2)
    own = F.array(*map(F.lit, ["from", "to", "call", "path", "chain", "the"]))
    code = F.filter(_tokens(question, "[A-Za-z_][A-Za-z0-9_.]*"), lambda t: F.rlike(t, F.lit("[A-Z_]")) & ~F.array_contains(own, F.lower(t)))
    two = F.size(code) >= 2
    pick = lambda got, at: F.when(a != "", got).when(two, F.try_element_at(code, F.lit(at))).otherwise("")
    return F.struct(pick(a, 1).alias("source"), pick(b, -1).alias("target"))


def question_type(question: Column) -> Column:
    """One of the question types; "unknown" where no pattern fits."""
    out = None
    for name, pattern in TYPES:
        test = F.rlike(question, F.lit(f"(?iU){pattern}"))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def question_symbols(question: Column) -> Column:
    """Up to five code-like names, else the first three words that are none of the common ones."""
    stop = F.array(*map(F.lit, ANALYSIS_STOP_WORDS))
    tokens = F.filter(_tokens(question, r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"), lambda t: ~F.array_contains(stop, F.lower(t)) & (F.length(t) > 2))
    code = F.slice(F.filter(tokens, lambda t: F.rlike(t, F.lit(r"[_.]|[a-z][A-Z]"))), 1, 5)
    return F.when(F.size(code) > 0, code).otherwise(F.slice(tokens, 1, 3))


def hint(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in HINTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("search, then read the sources"))
