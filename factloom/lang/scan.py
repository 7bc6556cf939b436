"""What the parsers share: text with strings and comments masked, matched brackets, call sites.

A masked text has the length of the source. Comments become spaces, strings runs of `"`; what a
string interpolates stays. Parsers look for structure in the mask and for names in the source.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

OPEN, CLOSE = "([{", ")]}"
PAIR = dict(zip(CLOSE, OPEN, strict=True))


class Source:
    """code, its mask, comments as spans, brackets as pairs of places."""

    def __init__(self, code: str, token: re.Pattern, holes: str = "", prefix: str = ""):
        """token: groups `comment` or `string`; holes: what opens an interpolation, prefix: letters of strings that interpolate."""
        self.code = code
        mask = list(code)
        self.comments: list[tuple[int, int]] = []
        self.strings: list[tuple[int, int]] = []
        at = 0
        while found := token.search(code, at):
            a, b = found.span()
            at = max(b, a + 1)
            if found.lastgroup == "comment":
                self.comments.append((a, b))
                mask[a:b] = [c if c == "\n" else " " for c in code[a:b]]
            elif found.lastgroup == "string":
                self.strings.append((a, b))
                mask[a:b] = ['"'] * (b - a)
                if holes and (not prefix or re.match(rf"[rRbBuU]*[{prefix}]", found[0])):
                    self._holes(mask, token, a, b, holes)
        self.mask = "".join(mask)
        self.pairs: dict[int, int] = {}
        self._match()
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def _holes(self, mask: list[str], token: re.Pattern, a: int, b: int, opener: str) -> None:
        """Uncovers interpolated code between a and b."""
        code, i = self.code, a
        while 0 <= (i := code.find(opener, i, b)):
            if opener == "{" and code.startswith("{{", i):
                i += 2
                continue
            start, depth, j = i + len(opener), 1, i + len(opener)
            while j < b and depth:
                depth += {"{": 1, "}": -1}.get(code[j], 0)
                j += 1
            if depth:
                return
            inner = list(code[start : j - 1])
            for found in token.finditer(code[start : j - 1]):
                if found.lastgroup == "string":
                    inner[slice(*found.span())] = ['"'] * (found.end() - found.start())
            mask[start : j - 1] = [" " if c == "\n" else c for c in inner]
            mask[start - 1], mask[j - 1] = "{", "}"
            i = j

    def _match(self) -> None:
        stack: list[int] = []
        mask, pairs = self.mask, self.pairs
        for found in re.finditer(r"[()\[\]{}]", mask):
            i, c = found.start(), found[0]
            if c in OPEN:
                stack.append(i)
            elif stack and mask[stack[-1]] == PAIR[c]:
                j = stack.pop()
                pairs[j], pairs[i] = i, j
            else:
                for k in range(len(stack) - 1, max(-1, len(stack) - 40), -1):
                    if mask[stack[k]] == PAIR[c]:
                        pairs[stack[k]], pairs[i] = i, stack[k]
                        del stack[k:]
                        break
        for i in stack:
            pairs[i] = len(mask)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def text(self, a: int, b: int) -> str:
        return self.code[a:b]

    def end(self, at: int) -> int:
        """One past the bracket that closes the one at `at`."""
        return min(self.pairs.get(at, at) + 1, len(self.mask))

    def split(self, a: int, b: int, by: str = ",", angles: bool = False) -> list[tuple[int, int]]:
        """Spans between separators outside brackets (and angle brackets of types); blank ones are left out."""
        out, start, i, depth = [], a, a, 0
        while i < b:
            c = self.mask[i]
            if c in OPEN and i in self.pairs:
                i = min(self.pairs[i], b)
            elif angles and c == "<":
                depth += 1
            elif angles and c == ">" and self.mask[i - 1] not in "-=":
                depth = max(0, depth - 1)
            elif c in by and not depth:
                out.append((start, i))
                start = i + 1
            i += 1
        out.append((start, b))
        return [(x, y) for x, y in out if self.mask[x:y].strip()]

    def comments_in(self, a: int, b: int) -> int:
        return bisect_left(self.comments, (b,)) - bisect_left(self.comments, (a,))

    def find(self, chars: str, a: int, b: int) -> int:
        """The first of chars between a and b outside brackets, or b."""
        i = a
        while i < b:
            c = self.mask[i]
            if c in chars:
                return i
            if c in OPEN and i in self.pairs:
                i = self.pairs[i]
            i += 1
        return b


NAME = re.compile(r"[^\W\d][\w$]*")
#: An opening parenthesis, with the word before it on its line.
OPENED = re.compile(r"(?:(?<![\w$])([\w$]++)[ \t]*+)?\(")


def sanitize_callee(text: str) -> str:
    if "\n" not in text and "(" not in text:
        return text.strip()
    head = text.split("(")[0]
    for c in "\n\r\t ":
        head = head.replace(c, "")
    return head.rsplit(".", 1)[-1]


class Calls:
    """Call sites by language: callee chains are read backwards from each opening parenthesis."""

    def __init__(self, keywords: str, joints: tuple[str, ...] = (".",), simple=lambda name: True, across_lines: bool = True):
        self.keywords = frozenset(keywords.split())
        self.joints = sorted(joints, key=len, reverse=True)
        self.simple = simple
        self.ends = frozenset(j[-1] for j in joints)
        self.blank = " \t\n\r" if across_lines else " \t"

    def back(self, mask: str, i: int, low: int, blank: str | None = None) -> int:
        """The place after the last character before i that isn't blank."""
        while i > low and mask[i - 1] in (blank or self.blank):
            i -= 1
        return i

    def atom(self, source: Source, end: int, low: int) -> int | None:
        """Where the name, string or bracket that ends at `end` starts."""
        mask = source.mask
        if end <= low:
            return None
        c = mask[end - 1]
        if c in CLOSE:
            opener = source.pairs.get(end - 1)
            return opener if opener is not None and opener >= low else None
        if c == '"':
            i = end
            while i > low and mask[i - 1] == '"':
                i -= 1
            return i
        i = end
        while i > low and (mask[i - 1].isalnum() or mask[i - 1] in "_$"):
            i -= 1
        return i if i < end else None

    def chain(self, source: Source, end: int, low: int) -> tuple[int, int, str] | None:
        """Start of the expression that ends at `end`, start of its last link, and the joint before that."""
        mask = source.mask
        start = self.atom(source, end, low)
        if start is None:
            return None
        last, joint = start, ""
        first = True
        while True:
            if mask[start] in OPEN:
                before = self.back(mask, start, low, " \t")
                inner = self.atom(source, before, low)
                word = mask[inner:before] if inner is not None else ""
                if inner is not None and (word not in self.keywords) and mask[before - 1] not in "}" and (mask[start] != "{"):
                    start = inner
                    if first:
                        last = start
                    continue
                return start, last, joint
            before = self.back(mask, start, low)
            found = next((j for j in self.joints if mask.endswith(j, low, before)), None)
            if found is None or (found == "." and mask.endswith("..", low, before)):
                return start, last, joint
            if first:
                last, joint, first = start, found, False
            inner = self.atom(source, self.back(mask, before - len(found), low), low)
            if inner is None or mask[inner : inner + 1] == "":
                return before - len(found), last, joint
            if mask[inner:before].strip() in self.keywords and mask[inner] not in OPEN:
                pass
            start = inner

    def sites(self, source: Source, a: int, b: int, skip: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, str]]:
        """(start, end, callee) of the calls between a and b, outer before inner, in order of place."""
        mask, out = source.mask, []
        spans, k, upto = sorted(skip), 0, a
        for found in OPENED.finditer(mask, a, b):
            i = found.end() - 1
            while k < len(spans) and spans[k][0] <= i:
                upto, k = max(upto, spans[k][1]), k + 1
            if i < upto:
                continue
            name, start = found[1], found.start()
            before = self.back(mask, start, a) if name else a
            if name and (before == a or mask[before - 1] not in self.ends):  # a name alone is its own callee
                site = None if name in self.keywords else (start, name)
            else:
                site = self.site(source, i, a)
            if site:
                out.append((site[0], source.end(i), site[1]))
        return iter(sorted(out, key=lambda s: (s[0], -s[1])))

    def site(self, source: Source, at: int, low: int) -> tuple[int, str] | None:
        """Start and callee of the call whose arguments open at `at`; None if it's no call."""
        mask = source.mask
        end = self.back(mask, at, low, " \t")
        if end <= low:
            return None
        c = mask[end - 1]
        if c == ">" and "::" in self.joints:  # type arguments of a path
            opener = mask.rfind("::<", low, end)
            found = self.chain(source, opener, low) if opener > low and "(" not in mask[opener:end] else None
            return (found[0], sanitize_callee(source.text(found[0], end))) if found else None
        if not (c.isalnum() or c in '_$)]"'):
            return None
        found = self.chain(source, end, low)
        if not found:
            return None
        start, last, joint = found
        word = mask[last:end].strip()
        if word in self.keywords and not joint:
            return None
        if joint in (".", "?.") and mask[last] not in OPEN and NAME.fullmatch(word):
            receiver = source.text(start, last).strip()
            receiver = receiver[: -len(joint)].strip() if receiver.endswith(joint) else receiver
            keep = NAME.fullmatch(receiver) and self.simple(receiver)
            return start, f"{receiver}.{word}" if keep else word
        return start, sanitize_callee(source.text(start, end))
