"""Facts of Elixir files: calls that define, and do-blocks."""

from __future__ import annotations

import re

from .facts import Facts
from .scan import Source

TOKEN = re.compile(
    r"""(?P<comment>\#(?!\{)[^\n]*)|(?P<string>~[a-zA-Z]\"\"\".*?(?:\"\"\"|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|~[a-zA-Z](?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|/[^/\n]*/|"[^"]*"|\|[^|]*\|)[a-z]*"""
    r"""|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\\n])*(?:'|$)|(?<![\w)])\?(?:\\.|[^\s]))""",
    re.S | re.M,
)
WORD = re.compile(r"(?<![\w.:@&%])(?P<word>(?:[A-Z]\w*\.)*(?:[a-z_]\w*[?!]?\.)*[a-z_]\w*[?!]?)(?!\w|:(?!:))")
BLOCKS = re.compile(r"(?<![\w.:@])(?:(do)(?![\w:])|(fn)(?![\w:])|(end)(?![\w:?!]))")
#: Calls that aren't recorded. Fixed values.
UNRECORDED = frozenset("def defp defmodule import use alias do end".split())
WORDS = frozenset("and or not in when do end fn else rescue catch after true false nil".split())
ARGUMENT = re.compile(r"[ \t]+(?=[\w\"':%@&^~\[{]|-\w)(?!(?:and|or|not|in|when|do|end|else|rescue|catch|after)\b(?!:))")


class Extractor:
    def __init__(self, code: str, facts: Facts):
        self.source = Source(code, TOKEN, "#{")
        self.facts = facts
        self.blocks: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for found in BLOCKS.finditer(self.source.mask):
            if found[3]:
                if stack:
                    self.blocks[stack.pop()[1]] = found.start()
            else:
                stack.append((found[0], found.start()))
        for _, at in stack:
            self.blocks[at] = len(self.source.mask)

    def head(self, at: int, b: int) -> tuple[int, int]:
        """(end of the arguments, place of the do-block or -1) of a call whose arguments start at `at`."""
        source, mask, i = self.source, self.source.mask, at
        while i < b:
            c = mask[i]
            if c in "([{" and i in source.pairs:
                i = source.end(i)
                continue
            word = BLOCKS.match(mask, i)
            if word and (i == 0 or not (mask[i - 1].isalnum() or mask[i - 1] == "_")):
                if word[1]:
                    return i, i
                if word[3]:
                    return i, -1
                i = self.blocks.get(i, b) + 3
                continue
            if c == "\n":
                before, after = mask[at:i].rstrip(), mask[i:b].lstrip()
                if not (before.endswith((",", "|>", "=", "\\", "when")) or after.startswith(("do\n", "do ", "|>", "when "))):
                    return i, -1
            if c == ";":
                return i, -1
            i += 1
        return b, -1

    def arguments(self, at: int, b: int) -> tuple[int, int, int, int]:
        """(start, end of the arguments, where the call's text ends, do-block or -1)."""
        source, mask = self.source, self.source.mask
        if mask[at : at + 1] == "(":
            end = source.end(at)
            stop, do = self.head(end, b)
            return at + 1, end - 1, stop, do if not mask[end:do].strip() else -1
        stop, do = self.head(at, b)
        return at, stop, stop, do

    def walk(self, a: int, b: int, module_id: str) -> None:
        source, mask, facts, at = self.source, self.source.mask, self.facts, a
        for found in WORD.finditer(mask, a, b):
            word, start = found["word"], found.start()
            if start < at or word not in ("defmodule", "def", "defp", "import", "use", "alias"):
                continue
            x, y, stop, do = self.arguments(found.end(), b)
            args = source.split(x, y)
            line = source.line(start)
            if not args:
                continue
            first = source.text(*args[0]).strip()
            if word == "defmodule":
                inner = facts.nested("defmodule", first, line)
                if do >= 0:
                    self.walk(do + 2, self.blocks[do], inner)
                at = self.blocks[do] + 3 if do >= 0 else stop
            elif word in ("def", "defp"):
                self.function(word, module_id, args[0], first, line, do)
                at = self.blocks[do] + 3 if do >= 0 else stop
            else:
                facts.depends(module_id, first, word, line)
                at = stop

    def function(self, word: str, module_id: str, span: tuple[int, int], head: str, line: int, do: int) -> None:
        source, facts = self.source, self.facts
        a = span[0] + len(source.mask[span[0] : span[1]]) - len(source.mask[span[0] : span[1]].lstrip())
        name, arity = head, 0
        called = re.match(r"([^\W\d]\w*[?!]?)(\(|[ \t]+(?=[\w\"':%\[{]))", source.mask[a : span[1]])
        if called:
            opener = a + called.end() - 1
            if called[2] == "(" and not source.mask[source.end(opener) : span[1]].strip():
                name = source.text(a, a + called.end(1))
                arity = len(source.split(opener + 1, source.end(opener) - 1)) + source.comments_in(opener + 1, source.end(opener) - 1)
            elif called[2] != "(" and not re.match(r"(?:when|and|or|in)\b", source.mask[a + called.end() :]):
                name, arity = source.text(a, a + called.end(1)), len(source.split(a + called.end(), span[1]))
        func_id = facts.function(module_id, name, arity, "private" if word == "defp" else "public", line)
        if do >= 0:
            self.calls(func_id, do + 2, self.blocks[do])

    def calls(self, func_id: str, a: int, b: int) -> None:
        source, mask = self.source, self.source.mask
        for found in WORD.finditer(mask, a, b):
            word, end = found["word"], found.end()
            if word in WORDS:
                continue
            called = mask[end : end + 1] == "(" or ("." in word and word[0].isupper())
            if not called and re.match(r"[ \t]*=(?![=~])|[ \t]*(?:->|<-|\|)", mask[end:b]):
                continue
            if not called:
                called = bool(ARGUMENT.match(mask, end, b)) or (
                    bool(re.match(r"[ \t]+do(?![\w:])", mask[end:b])) and bool(re.search(r"(?:^|[\n;=(,>|{\[])[ \t]*$", mask[max(a, found.start() - 80) : found.start()]))
                )
            if called and word not in UNRECORDED:
                self.facts.call(func_id, source.text(*found.span("word")), source.line(found.start()))


def extract(code: str, facts: Facts) -> None:
    Extractor(code, facts).walk(0, len(code), facts.module_id)
