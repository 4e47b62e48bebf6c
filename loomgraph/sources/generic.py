"""Definitions, imports, calls and raises of files in eight further languages, by line patterns.

No grammar is at hand, so this is an extension that reads lines, not trees: what a pattern can't see (a definition over
several lines, a brace in a string) is missed or cut short. Braces decide where a definition ends. It is off unless asked
for; without it such files give a file and a module only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = r"([A-Za-z_$][\w$]*)"
_JS_FUNCTION = rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}\s*\(([^)]*)\)|^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::[^=]+)?=>"
_JS_METHOD = rf"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME}\s*\(([^)]*)\)\s*(?::\s*[^{{]+)?\{{"
_TYPED_METHOD = rf"^\s+(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|synchronized)\s+)+(?:[\w<>\[\],.?]+\s+)?{_NAME}\s*\(([^)]*)\)"
_C_FUNCTION = rf"^(?!\s*(?:return|else|if|for|while|switch)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&]{_NAME}\s*\(([^;)]*)\)\s*(?:const\s*)?\{{?\s*$"

#: Patterns of each language: a class and what it extends, a function and a method with parameters, an import.
PATTERNS: dict[str, dict[str, str]] = {
    "javascript": {"class": rf"^\s*(?:export\s+)?(?:default\s+)?class\s+{_NAME}(?:\s+extends\s+([\w.$]+))?", "function": _JS_FUNCTION, "method": _JS_METHOD, "import": r"""^\s*(?:import|export)\b.*?from\s+['"]([^'"]+)['"]|^\s*import\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)"""},
    "java": {"class": rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+{_NAME}(?:.*?\bextends\s+([\w.]+))?", "method": _TYPED_METHOD, "import": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"},
    "go": {"class": rf"^type\s+{_NAME}\s+(?:struct|interface)\b", "function": rf"^func\s+{_NAME}\s*(?:\[[^\]]*\])?\(([^)]*)\)", "method": rf"^func\s+\([^)]*\)\s*{_NAME}\s*\(([^)]*)\)", "import": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$"""},
    "rust": {"class": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+{_NAME}", "function": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_NAME}\s*(?:<[^>]*>)?\(([^)]*)\)", "import": r"^\s*(?:pub\s+)?use\s+([\w:]+)"},
    "c": {"class": rf"^\s*(?:typedef\s+)?struct\s+{_NAME}\s*\{{", "function": _C_FUNCTION, "import": r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]"""},
    "cpp": {"class": rf"^\s*(?:class|struct)\s+{_NAME}(?:\s*:\s*(?:public|private|protected)?\s*([\w:]+))?\s*\{{?", "function": _C_FUNCTION, "import": r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]"""},
    "csharp": {"class": rf"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|record)\s+{_NAME}(?:\s*:\s*([\w.]+))?", "method": _TYPED_METHOD, "import": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"},
}
PATTERNS["typescript"] = PATTERNS["javascript"] | {"class": rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+{_NAME}(?:<[^>]*>)?(?:\s+extends\s+([\w.$]+))?"}
_COMPILED = {language: {k: re.compile(p) for k, p in kinds.items()} for language, kinds in PATTERNS.items()}
_CALL = re.compile(r"(?:([A-Za-z_$][\w$.]*)(?:\.|->|::))?([A-Za-z_$][\w$]*)\s*\(")
_RAISE = re.compile(r"\bthrow\s+(?:new\s+)?([A-Za-z_$][\w$.]*)|\bpanic!?\(")
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)")
_RECEIVER = re.compile(r"^func\s+\([^)]*?(\w+)(?:\[[^\]]*\])?\s*\)")
_COMMENT = re.compile(r"^\s*(?://|/\*|\*|#(?!\s*include))")
_NO_CALLS = frozenset("import if for while switch catch return function sizeof new throw else do match fn func def super typeof await".split())


def _parameters(text: str, language: str) -> list[dict]:
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        bare, _, default = part.partition("=")
        bare = bare.strip()
        if language in ("javascript", "typescript", "rust"):
            name, _, kind = bare.partition(":")
        elif language == "go":
            name, _, kind = bare.partition(" ")
        else:
            kind, _, name = bare.rpartition(" ")
        name = name.strip().lstrip("*&.").removeprefix("mut ")
        if name and name != "void":
            out.append({"name": name, "annotation": kind.strip() or None, "has_default": bool(default)})
    return out


def _ends(lines: list[str]) -> list[int]:
    """For each line: the line where the brace block that it opens, itself or on the next line, is closed; 0 without one."""
    out, open_ = [0] * len(lines), []
    for i, line in enumerate(lines):
        for c in line:
            if c == "{":
                open_.append(i)
            elif c == "}" and open_:
                at = open_.pop()
                out[at] = i + 1
    for i in range(len(lines) - 1):
        if not out[i] and lines[i + 1].strip() == "{":
            out[i] = out[i + 1]
    return out


def _definitions(lines: list[str], language: str) -> Iterator[dict]:
    patterns, ends = _COMPILED[language], _ends(lines)
    inside: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        inside = [x for x in inside if x[0] > i]
        if _COMMENT.match(line):
            continue
        block = _IMPL.match(line) if language == "rust" else None
        if block and ends[i]:
            inside.append((ends[i], block[1]))
            continue
        # a class first; within one, a method before a function
        for kind in ("class", "method", "function"):
            found = patterns[kind].match(line) if kind in patterns and (kind != "method" or inside or language == "go") else None
            if not found:
                continue
            groups = [g for g in found.groups() if g is not None]
            name, rest = groups[0], groups[1] if len(groups) > 1 else ""
            end = ends[i] or i + 1
            owner = inside[-1][1] if inside else ""
            if kind == "method" and language == "go":
                owner = _RECEIVER.match(line)[1]
            kind = "method" if kind == "function" and owner else kind
            qualified = f"{owner}.{name}" if owner else name
            above = lines[i - 1].strip() if i and lines[i - 1].strip().startswith(("@", "[", "#[")) else None
            yield {
                "kind": kind, "name": name, "qualified_name": qualified, "start_line": i + 1, "end_line": end, "params": [] if kind == "class" else _parameters(rest, language),
                "decorators": [above] if above else [], "bases": [rest] if kind == "class" and rest else [], "returns": None, "docstring": None,
                "is_cli_entry": kind != "class" and name in ("main", "Main"), "is_api_endpoint": bool(above and re.search(r"Mapping|Route|Http(?:Get|Post|Put|Delete)|get\(|post\(", above)), "signature": line.strip()[:300],
            }
            if kind == "class" and end > i + 1:
                inside.append((end, qualified))
            break


def facts(text: str | None, language: str) -> dict:
    """All facts of one file that lines show."""
    lines = (text or "").splitlines()
    out: dict = {"parse_error": False, "raw_error": None, "defs": list(_definitions(lines, language)), "imports": [], "calls": [], "raises": [], "assigns": []}
    defined = {d["start_line"] for d in out["defs"]}
    for i, line in enumerate(lines, 1):
        if _COMMENT.match(line):
            continue
        found = _COMPILED[language]["import"].search(line)
        if found:
            module = next(g for g in found.groups() if g)
            out["imports"].append({"module": module.replace("::", "."), "level": 0, "symbols": [re.split(r"[./:]", module.rstrip("*./"))[-1]], "originals": [re.split(r"[./:]", module.rstrip("*./"))[-1]], "line": i})
            continue
        for raised in _RAISE.finditer(line):
            out["raises"].append({"exception": (raised[1] or "panic").split(".")[-1], "line": i})
        for call in _CALL.finditer(line) if i not in defined else ():
            if call[2] not in _NO_CALLS:
                out["calls"].append({"callee": call[2], "is_method_call": bool(call[1]), "receiver": call[1], "line": i})
    return out
