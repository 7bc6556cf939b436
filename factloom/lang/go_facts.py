"""Facts of Go files: declarations at the root."""

from __future__ import annotations

import re

from .facts import Facts, clean_param
from .scan import Calls, Source

TOKEN = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>`[^`]*(?:`|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\[^\n]{1,9}?|[^\\'\n])')""", re.S | re.M)
CALLS = Calls("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
DECLARATION = re.compile(r"^(func|type|import)\b", re.M)


def params(source: Source, a: int, b: int) -> list[tuple[str, str]]:
    """One entry for each declaration: names that share a type are one, by the first name."""
    out: list[tuple[str, str]] = []
    pieces = [source.text(x, y).strip() for x, y in source.split(a, b)]
    typed = [re.match(r"([^\W\d]\w*)\s+(?=\S)(.+)|([^\W\d]\w*)\s*(\.\.\..+)", p, re.S) for p in pieces]
    typed = [m if m and not re.match(r"(?:chan|func|map|struct|interface)\b", p) else None for m, p in zip(typed, pieces, strict=True)]
    if not any(typed):
        return [(clean_param(p), clean_param(p)) for p in pieces]
    waiting = ""
    for piece, found in zip(pieces, typed, strict=True):
        if found:
            out.append((clean_param(waiting or found[1] or found[3]), clean_param((found[2] or found[4]).removeprefix("..."))))
            waiting = ""
        else:
            waiting = waiting or piece
    return out


def extract(code: str, facts: Facts) -> None:
    source = Source(code, TOKEN)
    mask, n, at = source.mask, len(source.mask), 0
    while found := DECLARATION.search(mask, at):
        at, kind = found.start(), found[1]
        line = source.line(at)
        if kind == "func":
            i = found.end()
            receiver = re.match(r"\s*\(", mask[i:])
            if receiver:
                i = source.end(i + receiver.end() - 1)
            name = re.match(r"\s*([^\W\d]\w*)\s*", mask[i:])
            if not name:
                at = found.end()
                continue
            i += name.end()
            if mask[i : i + 1] == "[":
                i = source.end(i)
            opener = source.find("(", i, n)
            entries = params(source, opener + 1, source.end(opener) - 1)
            arity = len(entries) + source.comments_in(opener + 1, source.end(opener) - 1)
            visibility = "public" if name[1][0].isupper() else "private"
            func_id = facts.function(facts.module_id, name[1], arity, visibility, line, entries)
            at = source.end(opener)
            # results may be in parentheses; a body opens on the same line
            body = re.compile(r"[^\n({]*(?:\(|(?P<body>\{))").match(mask, at)
            while body and not body["body"]:
                at = source.end(body.end() - 1)
                body = re.compile(r"[^\n({]*(?:\(|(?P<body>\{))").match(mask, at)
            while body and re.search(r"\b(?:interface|struct)\s*$", mask[at : body.end() - 1]):
                at = source.end(body.end() - 1)
                body = re.compile(r"[^\n{]*(?P<body>\{)").match(mask, at)
            if body:
                opener = body.end() - 1
                at = source.end(opener)
                for start, _, callee in CALLS.sites(source, opener + 1, at - 1):
                    if callee:
                        facts.call(func_id, callee, source.line(start))
        else:
            opener = re.match(r"\s*\(", mask[found.end() :])
            if opener:
                end = source.end(found.end() + opener.end() - 1)
            else:
                end = source.find("\n", found.end(), n)
            text = source.text(at, end)
            if kind == "type":
                parts = text.split()
                if len(parts) > 1:
                    facts.depends(facts.module_id, parts[1], "type", line)
            else:
                for row in text.splitlines():
                    quoted = re.search(r'"([^"]*)"', row)
                    if quoted:
                        facts.depends(facts.module_id, quoted[1], "import", line)
            at = max(end, found.end())
