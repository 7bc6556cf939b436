"""Facts of Ruby files: bodies between keywords and `end`, and what changes visibility in them."""

from __future__ import annotations

import re

from .facts import Facts, clean_param
from .scan import Source

TOKEN = re.compile(
    r"""(?P<comment>\#(?!\{)[^\n]*|^=begin\b.*?(?:^=end[^\n]*|\Z))|(?P<string><<[~-]?(["'`]?)([A-Z_][A-Z_0-9]*)\3[^\n]*\n.*?(?:^[ \t]*\4$|\Z)"""
    r"""|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})"""
    r"""|(?:(?<=[=(,!|&~\[{]|\n)|(?<=[=(,!|&~\[{]\ )|(?<=when\ )|(?<=if\ )|(?<=and\ ))/(?!\s)(?:\\.|[^/\\\n])+/[imxo]*)""",
    re.S | re.M,
)
OPENER = re.compile(r"(?<![\w.:@$])(?P<open>class|module|def|begin|case|for|while|until|if|unless|do)\b(?![?!:])|(?<![\w.:@$])(?P<end>end)\b(?![?!:])")
#: Calls that aren't recorded. Fixed values.
UNRECORDED = frozenset("require require_relative include extend prepend attr_reader attr_writer attr_accessor".split())
KEYWORDS = frozenset("__FILE__ __LINE__ alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split())
CALL = re.compile(r"(?<![\w@$:])(?P<name>[A-Za-z_]\w*[?!]?)")
ARGUMENT = re.compile(r"[ \t]+(?=[\w\"':@$\[{]|-\w|\*\w|&\w|->)(?!(?:do|if|unless|while|until|and|or|then|in|rescue|end|else)\b)(?!\{)")
VISIBILITIES = ("private", "protected", "public")


class Extractor:
    def __init__(self, code: str, facts: Facts):
        self.source = Source(code, TOKEN, "#{")
        self.facts = facts
        self.ends: dict[int, int] = {}
        mask, stack = self.source.mask, []
        for found in OPENER.finditer(mask):
            word, at = found["open"], found.start()
            if found["end"]:
                if stack:
                    self.ends[stack.pop()] = at
                continue
            line = mask[mask.rfind("\n", 0, at) + 1 : at]
            lead = line.strip()
            if word in ("if", "unless", "while", "until") and lead and not re.search(r"(?:[=(,;{|&]|\b(?:do|then|else|return|and|or|not|when))\s*$", lead):
                continue  # a modifier
            if word == "do" and re.search(r"(?:^|;)\s*(?:while|until|for)\b", line):
                continue
            if word == "def" and self.endless(at):
                continue
            stack.append(at)
        for at in stack:
            self.ends[at] = len(mask)

    def endless(self, at: int) -> bool:
        """`def name(...) = expression` on one line."""
        return bool(re.compile(r"def\s+[\w.]+[?!]?\s*(?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)\s*|\s+)=(?![=~>])").match(self.source.mask, at))

    def line_end(self, at: int, b: int) -> int:
        """Where the statement at `at` ends: commas and brackets carry it over lines."""
        mask, i = self.source.mask, at
        while i < b:
            c = mask[i]
            if c in "([{" and i in self.source.pairs:
                i = self.source.end(i)
                continue
            if c == ";" or (c == "\n" and not mask[at:i].rstrip().endswith((",", "\\", "."))):
                return i
            i += 1
        return b

    def body(self, a: int, b: int, module_id: str) -> None:
        """What stands between a and b: visibility runs from its start."""
        source, mask, facts = self.source, self.source.mask, self.facts
        current, overrides, at = "public", [], a
        token = re.compile(r"(?<![\w.:@$])(?:(?P<def>def)\s+|(?P<scope>class|module)\s+|(?P<word>private|protected|public|require|require_relative|include|extend|prepend)\b(?![?!:])|(?P<block>begin|case|for|while|until|if|unless|do)\b(?![?!:])|(?P<brace>\{))")
        while found := token.search(mask, at, b):
            start, line = found.start(), source.line(found.start())
            if found["def"]:
                at = self.method(start, b, module_id, current, overrides)
            elif found["scope"]:
                end = self.ends.get(start, b)
                name = re.compile(r"(?:<<\s*self\b|[\w:]+)").match(mask, found.end())
                text = source.text(*name.span()) if name else "Unknown"
                inner_id = module_id
                if not text.startswith("<<"):
                    inner_id = facts.nested(found["scope"], text, line)
                header = self.line_end(found.end(), end)
                self.body(header, end, inner_id)
                at = end + 3
            elif found["word"]:
                at = self.worded(found["word"], found.end(), b, module_id, line, overrides)
                if at < 0:
                    at, current = found.end(), found["word"]
            elif found["block"] and start in self.ends:
                self.body(found.end(), self.ends[start], module_id)
                at = self.ends[start] + 3
            elif found["brace"] and start in source.pairs:
                self.body(found.end(), source.pairs[start], module_id)
                at = source.end(start)
            else:
                at = found.end()

    def worded(self, word: str, at: int, b: int, module_id: str, line: int, overrides: list) -> int:
        """Where to go on after a bare call; -1 if it sets the visibility of what follows."""
        source, facts = self.source, self.facts
        end = self.line_end(at, b)
        rest = source.text(at, end)
        if word in VISIBILITIES:
            if not source.mask[at:end].strip():
                return -1
            if re.match(r"\s*def\b", source.mask[at:end]):  # the method is an argument
                inner = source.mask.index("def", at)
                return self.ends[inner] + 3 if inner in self.ends else end
            opener = re.match(r"\s*\(", rest)
            a, z = (at + opener.end(), source.end(at + opener.end() - 1) - 1) if opener else (at, end)
            overrides += [(source.text(x, y).strip().lstrip(":"), word) for x, y in source.split(a, z)]
            return end
        if word.startswith("require"):
            quoted = re.search(r"[\"']([^\"']*)[\"']", rest)
            if quoted and source.mask[at:end].strip():
                facts.depends(module_id, quoted[1], word, line)
        else:
            parts = (word + rest).split()
            if len(parts) >= 2:
                facts.depends(module_id, parts[1], parts[0], line)
        return end

    def method(self, at: int, b: int, module_id: str, current: str, overrides: list) -> int:
        source, mask = self.source, self.source.mask
        found = re.compile(r"def\s+(?P<on>(?:self|[A-Za-z_]\w*)\s*\.\s*)?(?P<name>[A-Za-z_]\w*[?!]?(?:=(?=[\s(])(?!\s*[\w\"(]+\s*\)?\s*$))?|\[\]=?|[+\-*/%<>=!~^&|]+@?)").match(mask, at, b)
        if not found:
            return at + 3
        name, i = source.text(*found.span("name")), found.end()
        if name.endswith("=") and name[0].isalpha() and mask[i : i + 1] != "(":
            name, i = name[:-1], i - 1
        endless = self.endless(at)
        entries, arity = [], 0
        opener = re.compile(r"[ \t]*\(").match(mask, i, b)
        if opener:
            x, y = opener.end(), source.end(opener.end() - 1) - 1
            i = y + 1
        else:
            x, y = i, self.line_end(i, b) if not endless else i
            i = y
        spans = source.split(x, y)
        entries = [self.param(source.text(p, q)) for p, q in spans]
        arity = len(spans) + source.comments_in(x, y)
        visibility = "public" if found["on"] else next((v for n, v in overrides if n == name), current)
        func_id = self.facts.function(module_id, name, arity, visibility, source.line(at), entries)
        end = self.line_end(i, b) if endless else self.ends.get(at, b)
        if endless:
            i = mask.index("=", i) + 1
        self.calls(func_id, i, end)
        return end if endless else end + 3

    def param(self, text: str) -> tuple[str, str]:
        text = text.strip()
        if text.startswith("("):
            return clean_param(next(iter(re.findall(r"\w+", text)), text)), ""
        name = re.match(r"(?:\*\*|\*|&)?\s*([^\W\d]\w*)", text)
        return clean_param(name[1] if name else text), ""

    def calls(self, func_id: str, a: int, b: int) -> None:
        source, mask = self.source, self.source.mask
        sites = []
        for found in CALL.finditer(mask, a, b):
            name, start, end = found["name"], found.start(), found.end()
            dot = re.search(r"(?:&\.|\.)[ \t\n]*$", mask[max(a, start - 80) : start])
            if dot and mask[max(a, start - 80) : start].rstrip().endswith(".."):
                dot = None
            if not dot and (name in KEYWORDS or mask[end : end + 1] == ":" and mask[end : end + 2] != "::"):
                continue
            if mask[end : end + 2] == "::" and not dot:
                continue
            called = bool(dot) or mask[end : end + 1] == "("
            if not called and (name[0].islower() or name[0] == "_"):
                called = bool(ARGUMENT.match(mask, end, b)) and not re.match(r"[ \t]*(?:[-+*/%|&^<>=]?=(?![=~>])|[-+*/<>|&]\s)", mask[end:b])
                called = called or bool(re.match(r"[ \t]*(?:\{|do\b)", mask[end:b])) or name.endswith(("?", "!")) and False
            if called and re.search(r"\bdef\s+(?:self\.)?$", mask[max(a, start - 20) : start]):
                continue
            if called and name not in UNRECORDED:
                first = self.chain_start(start, a) if dot else start
                close = source.end(end) if mask[end : end + 1] == "(" else end
                sites.append((first, -close, name))
        for start, _, name in sorted(sites, key=lambda s: s[:2]):
            self.facts.call(func_id, name, source.line(start))

    def chain_start(self, at: int, low: int) -> int:
        source, mask, i = self.source, self.source.mask, at
        while True:
            before = i
            while before > low and mask[before - 1].isspace():
                before -= 1
            if before > low and mask[before - 1] == ".":
                before -= 2 if mask[before - 2 : before] == "&." else 1
                while before > low and mask[before - 1].isspace():
                    before -= 1
            elif i != at:
                return i
            else:
                return i
            start = before
            while start > low and mask[start - 1] in ")]}" and (start - 1) in source.pairs:
                start = source.pairs[start - 1]
            while start > low and (mask[start - 1].isalnum() or mask[start - 1] in '_@$?!:"'):
                start -= 1
            if start >= before or start < low:
                return i
            i = start


def extract(code: str, facts: Facts) -> None:
    extractor = Extractor(code, facts)
    extractor.body(0, len(code), facts.module_id)
