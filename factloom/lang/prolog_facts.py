"""Facts of Prolog files, by an operator-precedence reader that gives up on one clause at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .facts import Facts, clean_param
from .registry import normalize_id

TOKEN = re.compile(
    r"""(?P<space>\s+|%[^\n]*|/\*.*?(?:\*/|\Z))|(?P<number>0'(?:\\.|''|.)|0[xob][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<var>[A-Z_]\w*)"""
    r"""|(?P<quoted>'(?:\\.|''|[^'\\])*')|(?P<string>"(?:\\.|""|[^"\\])*"|`(?:\\.|[^`\\])*`)|(?P<end>\.(?=\s|%|\Z))|(?P<atom>[^\W\d_A-Z]\w*|[+\-*/\\^<>=~:.?@\#&$]+|!|;)"""
    r"""|(?P<punct>[()\[\]{},|])""",
    re.S,
)
#: Infix operators with precedence and type. Fixed values of the language, and `::` of annotated clauses.
INFIX = {
    ":-": (1200, "xfx"), "-->": (1200, "xfx"), ";": (1100, "xfy"), "|": (1100, "xfy"), "->": (1050, "xfy"), "*->": (1050, "xfy"),
    ",": (1000, "xfy"), "::": (1000, "xfx"), ":=": (990, "xfx"), "<": (700, "xfx"), "=": (700, "xfx"), "=..": (700, "xfx"), "=@=": (700, "xfx"),
    "\\=@=": (700, "xfx"), "=:=": (700, "xfx"), "=<": (700, "xfx"), "==": (700, "xfx"), "=\\=": (700, "xfx"), ">": (700, "xfx"), ">=": (700, "xfx"),
    "@<": (700, "xfx"), "@=<": (700, "xfx"), "@>": (700, "xfx"), "@>=": (700, "xfx"), "\\=": (700, "xfx"), "\\==": (700, "xfx"), "as": (700, "xfx"),
    "is": (700, "xfx"), "#=": (700, "xfx"), "#\\=": (700, "xfx"), "#<": (700, "xfx"), "#>": (700, "xfx"), "#=<": (700, "xfx"), "#>=": (700, "xfx"),
    ">:<": (700, "xfx"), ":<": (700, "xfx"), ":": (200, "xfy"), "+": (500, "yfx"), "-": (500, "yfx"), "/\\": (500, "yfx"), "\\/": (500, "yfx"), "xor": (500, "yfx"),
    "*": (400, "yfx"), "/": (400, "yfx"), "//": (400, "yfx"), "mod": (400, "yfx"), "rem": (400, "yfx"), "<<": (400, "yfx"), ">>": (400, "yfx"),
    "div": (400, "yfx"), "rdiv": (400, "yfx"), "**": (200, "xfx"), "^": (200, "xfy"),
}
PREFIX = {
    ":-": (1200, "fx"), "?-": (1200, "fx"), "dynamic": (1150, "fx"), "discontiguous": (1150, "fx"), "initialization": (1150, "fx"), "table": (1150, "fx"),
    "multifile": (1150, "fx"), "module_transparent": (1150, "fx"), "\\+": (900, "fy"), "-": (200, "fy"), "+": (200, "fy"), "\\": (200, "fy"), "?": (500, "fx"), "$": (1, "fx"),
}
CONTROL = frozenset((",", ";", "|", "->", "*->"))


#: Terms within terms, at most; a clause with more is left out, and an `error` fact says so.
DEEPEST = 250


class Malformed(Exception):
    pass


class TooDeep(Malformed):
    pass


@dataclass
class Term:
    kind: str  # compound, atom, operator_atom, infix, prefix, cut, list, curly, paren, other
    start: int
    end: int
    name: str = ""
    args: "list[Term]" = field(default_factory=list)


class Reader:
    def __init__(self, code: str):
        self.code = code
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while at < len(code):
            found = TOKEN.match(code, at)
            if not found:
                at += 1
                continue
            if found.lastgroup != "space":
                self.tokens.append((found.lastgroup, found[0], *found.span()))
            at = max(found.end(), at + 1)
        self.i = 0
        self.depth = 0
        self.too_deep: list[int] = []  # where clauses start that are left out

    def peek(self) -> tuple[str, str, int, int]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("eof", "", len(self.code), len(self.code))

    def clauses(self):
        while self.i < len(self.tokens):
            start = self.i
            try:
                self.depth = 0
                term = self.term(1200)
                if self.peek()[0] not in ("end", "eof"):
                    raise Malformed
                self.i += 1
                yield term
            except (Malformed, RecursionError) as e:
                if not isinstance(e, Malformed) or isinstance(e, TooDeep):
                    self.too_deep.append(self.tokens[start][2])
                self.i = max(self.i, start)
                while self.peek()[0] not in ("end", "eof"):
                    self.i += 1
                self.i += 1

    def expect(self, text: str) -> int:
        token = self.peek()
        if token[0] != "punct" or token[1] != text:
            raise Malformed
        self.i += 1
        return token[3]

    def term(self, most: int) -> Term:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TooDeep
        left, level = self.primary(most)
        while True:
            kind, text, start, end = self.peek()
            if kind not in ("atom", "punct") or text not in INFIX:
                break
            precedence, shape = INFIX[text]
            if precedence > most or level > precedence - (shape[0] == "x"):
                break
            self.i += 1
            if shape == "xfy" and precedence >= 1000:  # bodies are long: a loop, folded from the right
                parts, names = [left, self.term(precedence - 1)], [text]
                while self.peek()[0] in ("atom", "punct") and INFIX.get(self.peek()[1]) == (precedence, "xfy"):
                    names.append(self.peek()[1])
                    self.i += 1
                    parts.append(self.term(precedence - 1))
                left = parts.pop()
                while parts:
                    part = parts.pop()
                    left = Term("infix", part.start, left.end, names.pop(), [part, left])
                level = precedence
                continue
            right = self.term(precedence - (shape[2] == "x"))
            left, level = Term("infix", left.start, right.end, text, [left, right]), precedence
        self.depth -= 1
        return left

    def arguments(self, close: str) -> list[Term]:
        out = [self.term(999)]
        while self.peek()[1] == "," and self.peek()[0] == "punct":
            self.i += 1
            out.append(self.term(999))
        return out

    def primary(self, most: int) -> tuple[Term, int]:
        kind, text, start, end = self.peek()
        if kind in ("eof", "end"):
            raise Malformed
        self.i += 1
        if kind in ("number", "var", "string"):
            return Term("other", start, end, text), 0
        if kind == "punct":
            if text == "(":
                inner = self.term(1200)
                return Term("paren", start, self.expect(")"), "", [inner]), 0
            if text == "{":
                if self.peek()[1] == "}":
                    return Term("atom", start, self.expect("}"), "{}"), 0
                inner = self.term(1200)
                return Term("curly", start, self.expect("}"), "", [inner]), 0
            if text == "[":
                if self.peek()[1] == "]":
                    return Term("list", start, self.expect("]")), 0
                items = self.arguments("]")
                if self.peek()[1] == "|":
                    self.i += 1
                    self.term(999)
                return Term("list", start, self.expect("]"), "", items), 0
            raise Malformed
        following = self.peek()
        if following[1] == "(" and following[2] == end:
            self.i += 1
            args = self.arguments(")") if self.peek()[1] != ")" else []
            return Term("compound", start, self.expect(")"), text, args), 0
        if text == "!":
            return Term("cut", start, end, text), 0
        if kind == "atom" and text in PREFIX:
            if text in "+-" and following[0] == "number" and following[2] == end:
                self.i += 1
                return Term("other", start, following[3], text + following[1]), 0
            ends = following[0] in ("eof", "end") or following[1] in (")", "]", "}", ",", "|") or (following[1] in INFIX and following[1] not in PREFIX and following[1] != "(")
            if not ends:
                precedence, shape = PREFIX[text]
                precedence = min(precedence, most)
                operand = self.term(precedence - (shape[1] == "x"))
                return Term("prefix", start, operand.end, text, [operand]), precedence
        if kind == "atom" and (text in INFIX or text in PREFIX):
            return Term("operator_atom", start, end, text), 0
        return Term("atom", start, end, text), 0


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] == "'" else text


class Extractor:
    def __init__(self, code: str, facts: Facts):
        self.code, self.facts = code, facts
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def line(self, at: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, at)

    def run(self) -> None:
        reader = Reader(self.code)
        clauses = list(reader.clauses())
        exported: set[str] = set()
        private = False
        for term in clauses:
            if term.kind == "prefix" and term.name in (":-", "?-"):
                private |= self.directive(term.args[0], exported)
        seen: set[str] = set()
        for term in clauses:
            if not (term.kind == "prefix" and term.name in (":-", "?-")):
                self.clause(term, seen, exported, private)
        for at in reader.too_deep:
            self.facts.add("error", name=f"a clause is nested over {DEEPEST} deep", line=self.line(at))

    def directive(self, goal: Term, exported: set[str]) -> bool:
        """Whether it declares a module, which makes what isn't exported private."""
        if goal.kind != "compound":
            return False
        name = unquoted(goal.name)
        if name == "module":
            if len(goal.args) > 1 and goal.args[1].kind == "list":
                for e in goal.args[1].args:
                    if e.kind == "infix" and e.name == "/":
                        a, b = (self.code[x.start : x.end] for x in e.args)
                        func_id = normalize_id(f"{unquoted(a)}_{b}")
                        exported.add(func_id)
                        if b.isdecimal():
                            self.facts.add("export", module_id=self.facts.module_id, func_id=func_id, name=unquoted(a), arity=int(b), line=self.line(e.start))
            return True
        if name in ("use_module", "ensure_loaded", "consult") and goal.args:
            first = goal.args[0]
            if first.kind == "compound" and unquoted(first.name) == "library" and first.args:
                dep = unquoted(self.code[first.args[0].start : first.args[0].end])
            else:
                dep = self.code[first.start : first.end].strip("'\"")
            if dep:
                self.facts.depends(self.facts.module_id, dep, name, self.line(goal.start))
        return False

    def clause(self, term: Term, seen: set[str], exported: set[str], private: bool) -> None:
        head, body = term, None
        if term.kind == "infix" and term.name in (":-", "-->"):
            head, body = term.args
        if head.kind == "infix" and head.name == "::":
            head = head.args[1]
        if head.kind not in ("compound", "atom", "operator_atom"):
            return
        name = unquoted(head.name)
        func_id = normalize_id(f"{name}_{len(head.args)}")
        line = self.line(term.start)
        if func_id in seen:
            self.facts.add("function_line", func_id=func_id, line=line)
        else:
            seen.add(func_id)
            visibility = "private" if private and func_id not in exported else "public"
            params = [(clean_param(self.code[a.start : a.end]), "") for a in head.args]
            self.facts.function(self.facts.module_id, name, len(head.args), visibility, line, params)
        if body is not None:
            self.goals(body, func_id)

    def goals(self, term: Term, func_id: str) -> None:
        stack = [term]
        while stack:
            t = stack.pop()
            if t.kind == "infix" and t.name in CONTROL:
                stack += reversed(t.args)
            elif t.kind == "infix" and t.name == ":":
                stack.append(t.args[1])
            elif t.kind == "prefix" and t.name == "\\+":
                stack.append(t.args[0])
            elif t.kind in ("paren", "curly"):
                stack += reversed(t.args)
            elif t.kind in ("infix", "prefix", "compound", "atom", "cut") and (name := unquoted(t.name)):
                self.facts.call(func_id, name, self.line(t.start))


def extract(code: str, facts: Facts) -> None:
    Extractor(code, facts).run()
