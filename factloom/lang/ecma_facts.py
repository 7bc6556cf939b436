"""Facts of JavaScript, TypeScript, JSX and TSX files."""

from __future__ import annotations

import re

from .facts import Facts, clean_param
from .scan import Calls, Source

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>`(?:\\.|[^`\\])*(?:`|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$)"""
    r"""|(?:(?<=[=(,:\[!&|?{};+*%~^>])|(?<=[=(,:\[!&|?{};+*%~^>]\ )|(?<=return\ )|(?<=\n))/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)""",
    re.S | re.M,
)
KEYWORDS = "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return switch throw try typeof var void while with yield"
CALLS = Calls(KEYWORDS + " super import", ("?.", "."), simple=lambda name: name not in ("this", "super"))
NODE = re.compile(
    r"(?P<arrow>=>)|\b(?P<import>import)\b(?!\s*[(.])|\b(?P<abstract>abstract\s+)?class\s+(?P<class>[A-Za-z_$][\w$]*)"
    r"|\bfunction\s+(?P<function>[A-Za-z_$][\w$]*)\s*(?=[(<])"
    r"|(?P<method>(?:\#?[A-Za-z_$][\w$]*|\"+|\[[^\[\]\n]*\]))\s*(?:<[^(){}]*>)?\s*\((?P<params>)"
)
NOT_METHODS = frozenset("if for while switch catch with function return typeof await super new".split())
MODIFIERS = ("public", "private", "protected", "static", "async", "get", "set", "override", "readonly")
WITH_BODY = re.compile(r"\s*(?::\s*(?:\{[^{}]*\}|[^;={}()]*(?:\([^()]*\)[^;={}()]*)?))?\s*(?=\{)")
NEW_LINE = re.compile(r"\s*(?![\s.?:&|+\-*/=<>,)\]}])")


# What stands before a place is read backwards from it, so that the length of a file doesn't count.


def back(mask: str, i: int, low: int) -> int:
    """The place after the last character before i that isn't blank."""
    while i > low and mask[i - 1].isspace():
        i -= 1
    return i


def word_before(mask: str, i: int, low: int, words: tuple[str, ...]) -> int:
    """Where the one of words that ends at i starts, or -1."""
    for word in words:
        at = i - len(word)
        if mask.endswith(word, low, i) and (at == low or not (mask[at - 1].isalnum() or mask[at - 1] == "_")):
            return at
    return -1


def modified(mask: str, i: int, low: int) -> int:
    """Where the modifiers and asterisks that end at i start, or i."""
    while True:
        before = back(mask, i, low)
        if before > low and mask[before - 1] == "*":
            i = before - 1
        elif before < i and (start := word_before(mask, before, low, MODIFIERS)) >= 0:
            i = start
        else:
            return i


def param(text: str, typescript: bool) -> tuple[str, str]:
    text = text.strip()
    if typescript:
        text = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+)*", "", text)
    depth, colon, equals = 0, -1, -1
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1] != "="):
            depth -= 1
        elif not depth and c == ":" and colon < 0 and equals < 0:
            colon = i
        elif not depth and c == "=" and text[i + 1 : i + 2] not in (">", "=") and equals < 0:
            equals = i
    stop = equals if equals >= 0 else len(text)
    name = text[: colon if colon >= 0 else stop].strip()
    kind = text[colon + 1 : stop] if colon >= 0 else ""
    if typescript:
        return clean_param(name.removesuffix("?").strip()), clean_param(kind)
    if name.startswith("..."):
        name = name[3:].strip()
    if name[:1] in "{[":
        bound = re.findall(r":\s*([A-Za-z_$][\w$]*)|\.\.\.([A-Za-z_$][\w$]*)", name) if name[0] == "{" else re.findall(r"([A-Za-z_$][\w$]*)()", name)
        name = next((a or b for a, b in bound), name)
    return clean_param(name), clean_param(kind)


class Extractor:
    def __init__(self, code: str, facts: Facts):
        self.source = Source(code, TOKEN, "${")
        self.facts = facts
        self.typescript = facts.language == "typescript"

    def run(self) -> None:
        self.walk(0, len(self.source.mask), self.facts.module_id, False)

    def nodes(self, a: int, b: int, members: bool) -> list[tuple[int, int, str, re.Match]]:
        """(start, end, kind, match) of what stands between a and b, by start."""
        source, mask, out = self.source, self.source.mask, []
        for found in NODE.finditer(mask, a, b):
            at = found.start()
            if found["arrow"]:
                start = self.arrow_start(at, a)
                if start is not None:
                    out.append((start, self.arrow_end(found.end(), b), "arrow", found))
            elif found["import"]:
                before = back(mask, at, a)
                if before == a or mask[before - 1] in ";}" or "\n" in mask[before:at]:
                    end = self.statement_end(found.end(), b)
                    out.append((at, end, "import", found))
            elif found["class"]:
                body = source.find("{", found.end(), b)
                out.append((at, source.end(body) if body < b else b, "class", found))
            elif found["function"]:
                out.append(self.with_body(at, found.end(), b, "function", found))
            else:
                before = back(mask, at, a)
                name = found["method"].strip()
                opener = mask.find("(", found.end() - 1, b)
                if name in NOT_METHODS or mask.endswith((".", "=>"), a, before) or word_before(mask, before, a, ("function", "new")) >= 0:
                    continue
                if mask.endswith("*", a, before) and word_before(mask, back(mask, before - 1, a), a, ("function",)) >= 0:
                    continue
                node = self.with_body(at, opener, b, "method", found)
                if node[1] >= 0:
                    out.append((modified(mask, at, a), *node[1:]))
        nodes = [n for n in out if n[1] >= 0]
        return sorted(nodes, key=lambda n: (n[0], -n[1]))

    def with_body(self, at: int, i: int, b: int, kind: str, found: re.Match) -> tuple[int, int, str, re.Match]:
        source, mask = self.source, self.source.mask
        opener = mask.find("(", i, b)
        if opener < 0:
            return at, -1, kind, found
        close = source.end(opener)
        after = WITH_BODY.match(mask, close, b)
        if not after:
            return at, -1, kind, found
        return at, source.end(after.end()), kind, found

    def arrow_start(self, at: int, low: int) -> int | None:
        source, mask = self.source, self.source.mask
        i = back(mask, at, low)
        if i > low and mask[i - 1] != ")":
            last = i
            while last > low and mask[last - 1] not in "()=;{}":
                last -= 1
            typed = re.compile(r"\)\s*:").match(mask, last - 1, i) if last > low else None
            if typed and not re.search(r"(?:^|[^\w$.])async\s+[\w$]+$|[(,=]\s*[\w$]+$", mask[max(low, i - 60) : i]):
                i = last
        if i <= low:
            return None
        if mask[i - 1] == ")":
            start = source.pairs.get(i - 1)
            if start is None or start < low:
                return None
        else:
            start = i
            while start > low and (mask[start - 1].isalnum() or mask[start - 1] in "_$"):
                start -= 1
            word = re.compile(r"[A-Za-z_$]").search(mask, start, i)
            if not word:
                return None
            start = word.start()
        before = word_before(mask, back(mask, start, low), low, ("async",))
        return before if before >= 0 else start

    def arrow_end(self, i: int, b: int) -> int:
        mask = self.source.mask
        while i < b and mask[i].isspace():
            i += 1
        if mask[i : i + 1] == "{":
            return self.source.end(i)
        return self.expression_end(i, b)

    def expression_end(self, i: int, b: int) -> int:
        source, mask = self.source, self.source.mask
        while i < b:
            c = mask[i]
            if c in ",;)]}":
                return i
            if c in "([{" and i in source.pairs:
                i = source.pairs[i]
            elif c == "\n" and NEW_LINE.match(mask, i, b) and re.search(r"[\w$\")\]}]\s*$", mask[max(0, i - 80) : i]):
                return i
            i += 1
        return b

    def statement_end(self, i: int, b: int) -> int:
        source, mask = self.source, self.source.mask
        while i < b:
            if mask[i] == ";":
                return i
            if mask[i] == "{" and i in source.pairs:
                i = source.pairs[i]
            elif mask[i] == "\n" and re.search(r'"\s*$', mask[max(0, i - 80) : i]):
                return i
            i += 1
        return b

    def walk(self, a: int, b: int, module_id: str, members: bool) -> None:
        source, at = self.source, a
        for start, end, kind, found in self.nodes(a, b, members):
            if start < at:
                continue
            if kind == "import":
                self.imported(start, end, module_id)
                at = end
            elif kind == "class":
                body = source.find("{", found.end(), b)
                if self.declares(start, a) and not found["abstract"]:
                    class_id = self.facts.nested("class", found["class"], source.line(start))
                else:
                    class_id = module_id
                if body < b:
                    self.walk(body + 1, end - 1, class_id, True)
                at = end
            elif kind == "function" and not self.declares(start, a):
                continue
            else:
                self.function(start, end, kind, found, module_id)
                at = end

    def declares(self, at: int, low: int) -> bool:
        """Whether a class or function stands as a statement."""
        mask = self.source.mask
        before = back(mask, at, low)
        for words in (("async", "default", "export", "declare", "abstract"), ("default", "export", "declare"), ("export",)):
            if (start := word_before(mask, before, low, words)) >= 0:
                before = back(mask, start, low)
        return before == low or mask[before - 1] in ";{})" or "\n" in mask[before:at] and mask[before - 1] not in "=(,:?&|+["

    def imported(self, a: int, b: int, module_id: str) -> None:
        found = re.search(r"from.*?[\"'](.*?)[\"']", self.source.text(a, b), re.S)
        if found:
            self.facts.depends(module_id, found[1], "import", self.source.line(a))

    def function(self, start: int, end: int, kind: str, found: re.Match, module_id: str) -> None:
        source, mask = self.source, self.source.mask
        entries, arity, body = [], 0, None
        opener = -1
        if kind == "arrow":
            name = "anonymous"
            first = re.compile(r"(?:async\s*)?(?=\()").match(mask, start, end)
            opener = first.end() if first else -1
            body = found.end()
        else:
            name = found["function"] or source.text(*found.span("method")).strip()
            opener = mask.find("(", found.end() - (1 if kind == "method" else 0), end)
            body = source.find("{", source.end(opener), end)
        if opener >= 0:
            a, b = opener + 1, source.end(opener) - 1
            spans = source.split(a, b, angles=self.typescript)
            arity = len(spans) + source.comments_in(a, b)
            entries = [param(source.text(x, y) if not source.comments_in(x, y) else re.sub(r"//[^\n]*|/\*.*?\*/", " ", source.text(x, y), flags=re.S), self.typescript) for x, y in spans]
        func_id = self.facts.function(module_id, name, arity, "public", source.line(start), entries)
        whole = re.compile(r"\s*").match(mask, body, end).end()
        expression = kind == "arrow" and mask[whole : whole + 1] != "{"
        skip = [(source_at, source_at + 1) for source_at in self.heads(body, end)]
        for at, stop, callee in CALLS.sites(source, body, end, skip):
            if callee and not (expression and at == whole and stop >= back(mask, end, 0)):
                self.facts.call(func_id, callee, source.line(at))

    def heads(self, a: int, b: int) -> list[int]:
        """Parentheses of parameters of functions and methods inside a body: no calls."""
        mask, out = self.source.mask, []
        for found in re.finditer(r"\bfunction\b\s*\*?\s*[\w$]*\s*\(", mask[a:b]):
            out.append(a + found.end() - 1)
        for start, end, kind, found in self.nodes(a, b, True):
            if kind == "method":
                out.append(mask.find("(", found.end() - 1, end))
        return out


def extract(code: str, facts: Facts) -> None:
    Extractor(code, facts).run()
