"""Facts of Python files: logical lines and their indentation."""

from __future__ import annotations

import re

from .facts import Facts, clean_param
from .scan import Calls, Source

TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<string>\b[rRbBuUfFtT]{0,2}(?:\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z)|'''(?:\\.|(?!''').)*(?:'''|\Z))"""
    r"""|\b[rRbBuUfFtT]{0,2}(?:"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$))"""
    r"""|\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z)|'''(?:\\.|(?!''').)*(?:'''|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$))""",
    re.S | re.M,
)
CALLS = Calls("and as assert async await break case class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield", across_lines=False)
DEF = re.compile(r"(?:async\s+)?def\s+(\w+)\s*(?:\[)?")
CLASS = re.compile(r"class\s+(\w+)")
COMPOUND = re.compile(r"(?:if|elif|else|for|while|try|except|finally|with|async|match|case)\b")

#: Where a logical line ends or doesn't: line ends, strings, brackets.
STOPS = re.compile(r'\n|"+|[(\[{]')


def logical_lines(source: Source) -> list[tuple[int, int, int]]:
    """(start, end, indent) of lines that aren't blank; brackets and backslashes join lines."""
    out, at, mask, n = [], 0, source.mask, len(source.mask)
    while at < n:
        end = at
        while end < n:
            if not (found := STOPS.search(mask, end)):
                end = n
                break
            end, c = found.start(), found[0]
            if c == "\n":
                if not mask.endswith("\\", at, end):
                    break
            elif c[0] == '"':
                end = found.end() - 1
            elif end in source.pairs:
                end = min(source.pairs[end], n - 1)
            end += 1
        text = mask[at:end]
        if text.strip():
            first = at + len(text) - len(text.lstrip())
            indent = len(text[: first - at].expandtabs(8))
            out.append((first, at + len(text.rstrip()), indent))
        at = end + 1
    return out


def param(text: str, mask: str) -> tuple[str, str]:
    stripped = mask.strip()
    if stripped in ("*", "/"):
        return stripped, ""
    colon, equals = mask.find(":"), mask.find("=")
    if 0 <= equals < colon:
        colon = -1
    stop = equals if equals >= 0 else len(mask)
    name = text[: colon if colon >= 0 else stop].strip().lstrip("*")
    return clean_param(name), clean_param(text[colon + 1 : stop]) if colon >= 0 else ""


def visibility(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") else "private"
    return "protected" if name.startswith("_") else "public"


def extract(code: str, facts: Facts) -> None:
    source = Source(code, TOKEN, "{", "fFtT")
    lines = logical_lines(source)
    scopes: list[tuple[int, str]] = []  # indents of open classes
    i = 0
    while i < len(lines):
        start, end, indent = lines[i]
        while scopes and indent <= scopes[-1][0]:
            scopes.pop()
        module_id = scopes[-1][1] if scopes else facts.module_id
        j = i + 1
        while j < len(lines) and lines[j][2] > indent:
            j += 1
        last = lines[j - 1][1]
        at = start
        while at < end:
            text = source.mask[at:end]
            if found := DEF.match(text):
                function(source, facts, module_id, found[1], at, end, last)
                i = j - 1
                break
            if found := CLASS.match(text):
                name = found[1]
                class_id = facts.nested("class", name, source.line(at))
                scopes.append((indent, class_id))
                module_id = class_id
                at = source.find(":", at, end) + 1
            elif COMPOUND.match(text):
                at = source.find(":", at, end) + 1
            else:
                stop = source.find(";", at, end)
                statement(source, facts, module_id, at, stop)
                at = stop + 1
            at += len(source.mask[at:end]) - len(source.mask[at:end].lstrip())
        i += 1


def statement(source: Source, facts: Facts, module_id: str, a: int, b: int) -> None:
    text = source.text(a, b).rstrip()
    if re.match(r"import\b", text):
        if text.startswith("import "):
            facts.depends(module_id, (text[7:].split() or [""])[0], "import", source.line(a))
    elif re.match(r"from\b", text) and text.startswith("from ") and not re.match(r"from\s+__future__\b", text):
        parts = text.split()
        if len(parts) >= 2:
            facts.depends(module_id, parts[1], "import_from", source.line(a))


def function(source: Source, facts: Facts, module_id: str, name: str, at: int, end: int, last: int) -> None:
    """at: of the def; end: of its logical line; last: of its block."""
    opener = source.mask.find("(", at, end)
    arity, params = 0, []
    colon = source.find(":", at, end)
    if 0 <= opener < colon:
        a, b = opener + 1, source.end(opener) - 1
        spans = source.split(a, b)
        arity = len(spans) + source.comments_in(a, b)
        params = [param(uncommented(source, x, y), source.mask[x:y]) for x, y in spans]
    func_id = facts.function(module_id, name, arity, visibility(name), source.line(at), params)
    if not facts.with_calls:
        return
    body = source.find(":", source.end(opener) if opener >= 0 else at, end) + 1
    headers = [m.span() for m in re.finditer(r"\b(?:def|class)\s+\w+\s*\(?", source.mask[body:last])]
    skip = [(body + x, body + y) for x, y in headers]
    for start, _, callee in CALLS.sites(source, body, last, skip):
        if callee:
            facts.call(func_id, callee, source.line(start))


def uncommented(source: Source, a: int, b: int) -> str:
    return "".join(c if m != " " or c.isspace() else " " for c, m in zip(source.code[a:b], source.mask[a:b], strict=True))
