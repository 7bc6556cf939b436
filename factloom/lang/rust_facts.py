"""Facts of Rust files: items at the root, and functions in impl blocks."""

from __future__ import annotations

import re

from .facts import Facts, clean_param
from .registry import normalize_id
from .scan import OPEN, Calls, Source

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\b(?:b|c)?r(\#*)".*?(?:"\3|\Z)|b?"(?:\\.|[^"\\])*(?:"|\Z)|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^\\'\n])')""",
    re.S,
)
CALLS = Calls("as async await box break continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while yield", (".", "::"))
ITEM = re.compile(
    r"(?P<pub>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*\"+)?)\s+)*"
    r"(?P<kind>fn|struct|enum|trait|impl|use|mod)\b\s*(?P<name>(?:r\#)?\w*)"
)


def angle_end(mask: str, at: int, end: int) -> int:
    """One past the `>` that closes the `<` at `at`."""
    depth = 0
    for i in range(at, end):
        if mask[i] == "<":
            depth += 1
        elif mask[i] == ">" and mask[i - 1] not in "-=":
            depth -= 1
            if not depth:
                return i + 1
    return end


def items(source: Source, a: int, b: int):
    """(match, start, end) of the items between a and b, not those inside them."""
    mask, at = source.mask, a
    while at < b:
        c = mask[at]
        if c.isspace():
            at += 1
            continue
        found = ITEM.match(mask, at, b)
        if found:
            stop = at
            while stop < b:
                stop = source.find(";{", found.end() if stop == at else stop, b)
                break
            end = source.end(stop) if stop < b and mask[stop] == "{" else min(stop + 1, b)
            if found["kind"] == "use":
                end = min(source.find(";", found.end(), b) + 1, b)
            yield found, at, end
            at = max(end, found.end())
        elif c in OPEN:
            at = source.end(at)
        else:
            at += len(re.match(r"\w+|.", mask[at:b], re.S)[0])


def param(text: str) -> tuple[str, str]:
    text = re.sub(r"^(?:#\s*\[[^\]]*\]\s*)+", "", text.strip())
    if re.fullmatch(r"(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self", text):
        return "self", ""
    name, colon, kind = text.partition(":")
    while kind.startswith(":"):  # a path in a pattern
        more, colon, kind = kind[1:].partition(":")
        name += "::" + more
    return clean_param(re.sub(r"^mut\s+", "", name.strip())), clean_param(kind.strip()) if colon else ""


def function(source: Source, facts: Facts, found: re.Match, at: int, end: int, prefix: str = "") -> None:
    mask = source.mask
    i = found.end()
    while i < end and mask[i].isspace():
        i += 1
    if i < end and mask[i] == "<":
        i = angle_end(mask, i, end)
    i = source.find("(", i, end) if mask[i : i + 1] != "(" else i
    spans = source.split(i + 1, source.end(i) - 1, angles=True) if i < end else []
    attributes = sum(len(re.findall(r"#\s*\[", mask[x:y])) for x, y in spans)
    arity = len(spans) + attributes + (source.comments_in(i + 1, source.end(i) - 1) if i < end else 0)
    params = [param(plain(source, x, y)) for x, y in spans]
    name = found["name"]
    visibility = "public" if found["pub"] else "private"
    func_id = facts.function(facts.module_id, name, arity, visibility, source.line(at), params, prefix)
    body = source.find("{", source.end(i) if i < end else at, end)
    if body < end:
        for start, _, callee in CALLS.sites(source, body + 1, end - 1, silent(source, body + 1, end - 1)):
            if callee:
                facts.call(func_id, callee, source.line(start))


def plain(source: Source, a: int, b: int) -> str:
    """The source without its comments."""
    return "".join(c if m != " " or c.isspace() else " " for c, m in zip(source.code[a:b], source.mask[a:b], strict=True))


def silent(source: Source, a: int, b: int) -> list[tuple[int, int]]:
    """Spans without calls: what macros hold, patterns, attributes, heads of inner functions."""
    mask, out = source.mask, []
    for m in re.finditer(r"\w!\s*([(\[{])", mask[a:b]):
        at = a + m.start(1)
        out.append((at, source.end(at)))
    for m in re.finditer(r"#!?\s*\[", mask[a:b]):
        out.append((a + m.start(), source.end(a + m.end() - 1)))
    for m in re.finditer(r"\blet\b", mask[a:b]):
        at = a + m.end()
        stop = at
        while True:
            stop = source.find("=;", stop, b)
            if stop < b and mask[stop] == "=" and mask[stop + 1 : stop + 2] == "=":
                stop += 2
                continue
            break
        out.append((at, stop))
    for m in re.finditer("=>", mask[a:b]):
        at = start = a + m.start()
        while start > a and mask[start - 1] not in ",{;":
            start -= 1
            if mask[start] in ")]}":
                start = source.pairs.get(start, start)
                if mask[start] == "{" and not mask[start:at].strip().startswith("{") is False and re.search(r"[\w>)]\s*$", mask[a:start]) is None:
                    break
        pattern = mask[start:at]
        guard = re.search(r"\bif\b", pattern)
        out.append((start, start + guard.start() if guard else at))
    for m in re.finditer(r"\bfn\s+\w+", mask[a:b]):
        at = source.find("({;", a + m.end(), b)
        out.append((a + m.start(), source.end(at) if at < b else b))
    return out


def extract(code: str, facts: Facts) -> None:
    source = Source(code, TOKEN)
    n = len(source.mask)
    for found, at, end in items(source, 0, n):
        kind, name = found["kind"], found["name"]
        if kind == "fn" and name:
            function(source, facts, found, at, end)
        elif kind in ("struct", "enum", "trait") and name:
            facts.module(normalize_id(name), name, f"type:{facts.module_id}", source.line(at))
        elif kind == "mod" and name:
            facts.depends(facts.module_id, name, "mod", source.line(at))
        elif kind == "use":
            text = source.text(at, end)
            if text.startswith("use ") and text[4:].split():
                facts.depends(facts.module_id, text[4:].split()[0].rstrip(";").replace("::", "."), "use", source.line(at))
        elif kind == "impl":
            head = at + source.mask[at:end].index("impl") + 4
            body = source.find("{", head, end)
            while head < body and source.mask[head].isspace():
                head += 1
            if source.mask[head : head + 1] == "<":
                head = angle_end(source.mask, head, body)
            text = re.split(r"\bwhere\b", plain(source, head, body))[0]
            depth, start = 0, 0
            for m in re.finditer(r"<|(?<![-=])>|\bfor\b(?!\s*<)", text):
                depth += {"<": 1, ">": -1}.get(m[0], 0)
                if m[0] == "for" and not depth:
                    start = m.end()
            prefix = normalize_id(text[start:].strip())
            for inner, x, y in items(source, body + 1, end - 1):
                if inner["kind"] == "fn" and inner["name"]:
                    function(source, facts, inner, x, y, prefix)
