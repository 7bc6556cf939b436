"""Facts of small files in every language, the quirks among them, and broken input."""

import ast
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.lang import LANGUAGES, file_facts
from factloom.lang.facts import clean_param
from factloom.lang.registry import language_of, module_of, normalize_id
from factloom.lang.scan import sanitize_callee

PATHS = {"python": "src/a.py", "rust": "src/a.rs", "typescript": "src/a.ts", "javascript": "src/a.js", "go": "src/a.go", "elixir": "a.ex", "ruby": "a.rb", "prolog": "a.pl"}


def facts(code, language, path=None):
    rows = file_facts(code, language, path or PATHS[language])
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    return rows


def functions(code, language):
    return [(r["name"], r["arity"], r["visibility"], r["line"]) for r in facts(code, language) if r["predicate"] == "function"]


def calls(code, language):
    return [(r["caller_id"], r["called_func"], r["line"]) for r in facts(code, language) if r["predicate"] == "calls_external"]


def callees(code, language):
    return [c for _, c, _ in calls(code, language)]


def params(code, language):
    return [(r["position"], r["name"], r["type"]) for r in facts(code, language) if r["predicate"] == "function_param"]


def deps(code, language):
    return [(r["dep_name"], r["kind"], r["line"]) for r in facts(code, language) if r["predicate"] == "depends_on"]


def modules(code, language):
    return [(r["module_id"], r["filepath"]) for r in facts(code, language) if r["predicate"] == "module"][1:]


def test_python_functions_and_visibility():
    code = "def a(): pass\ndef _b(x, y=1): pass\ndef __c(*, k): pass\nasync def __d__(self, /): pass\nclass K(B):\n    def m(self): pass\n"
    assert functions(code, "python") == [("a", 0, "public", 1), ("_b", 2, "protected", 2), ("__c", 2, "private", 3), ("__d__", 2, "public", 4), ("m", 1, "public", 6)]
    assert modules(code, "python") == [("k", "class:K")]


def test_python_params_and_calls():
    code = 'def f(a, b: dict[str, int] = {}, *args, c="x,y", **kw):\n    def inner(z):\n        return g(z)\n    return self.h(a.b.c(1))(2).d(f"{e(1)}")\n'
    assert params(code, "python") == [(0, "a", None), (1, "b", "dict[str, int]"), (2, "args", None), (3, "c", None), (4, "kw", None)]
    assert callees(code, "python") == ["g", "d", "h", "self.h", "c", "e"]
    assert [f[0] for f in functions(code, "python")] == ["f"]


def test_python_imports():
    code = "import os, sys\nimport a.b as c\nfrom . import x\nfrom __future__ import annotations\nif True:\n    from q import (\n        r)\ndef f():\n    import hidden\n"
    assert deps(code, "python") == [("os,", "import", 1), ("a.b", "import", 2), (".", "import_from", 3), ("q", "import_from", 6)]


def test_python_module_names():
    assert module_of("x.py.py", "python") == ("x", "x")
    assert module_of("./src/a.py", "python") == ("__src_a", "..src.a")
    assert module_of("a.js.ts", "typescript")[1] == "a.js" and module_of("a.ts.js", "javascript")[1] == "a"


def test_rust_items():
    code = """use serde::{A, B};
pub use x::y;
mod t { fn hidden() {} }
pub struct S;
enum E { A }
trait T { fn sig(&self); }
pub(crate) fn free<T: X<Y>>(a: HashMap<K, V>, mut b: &str) -> R { go(a)?; }
impl<T> Foo for S<T> { fn new(&mut self, x: i32) { self.a.b(c::d(x)); println!("{}", no(1)); } }
"""
    assert functions(code, "rust") == [("free", 2, "public", 7), ("new", 2, "private", 8)]
    assert deps(code, "rust") == [("serde.{A,", "use", 1), ("t", "mod", 3)]
    assert modules(code, "rust") == [("s", "type:src__a"), ("e", "type:src__a"), ("t", "type:src__a")]
    assert [r["func_id"] for r in facts(code, "rust") if r["predicate"] == "function"] == ["free_2", "s_t__new_2"]
    assert params(code, "rust") == [(0, "a", "HashMap<K, V>"), (1, "b", "&str"), (0, "self", None), (1, "x", "i32")]
    assert callees(code, "rust") == ["go", "b", "c::d"]


def test_rust_patterns_are_no_calls():
    code = "fn f(x: O) { if let Some(y) = g(x) { } match x { Ok(z) if h(z) => k(z), Err(e) => {} } let P(q) = r(); v::<T>(1); }"
    assert callees(code, "rust") == ["g", "h", "k", "r", "v::<T>"]


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_ecma_functions(language):
    code = """import a, {b} from "mod";
import './side';
export default class K extends L { constructor(x) { super(x); this.db.find(q(1)); } static go() { this.run(); } }
const h = async (a, b = 2) => { console.log(a); };
const one = x => call(x);
function top(a, {b, c}) { return f(a, y => g(y)); }
const fe = function named() { hidden(); };
"""
    assert functions(code, language) == [
        ("constructor", 1, "public", 3), ("go", 0, "public", 3), ("anonymous", 2, "public", 4), ("anonymous", 0, "public", 5), ("top", 2, "public", 6),
    ]
    assert modules(code, language) == [("k", "class:K")]
    assert deps(code, language) == [("mod", "import", 1)]
    assert callees(code, language) == ["find", "q", "run", "console.log", "f", "g"]


def test_typescript_params():
    code = "class K { m(private a: Map<K, V>, b?: string, ...c: number[]): void { if (x) { y(); } } }\nexport function f(a: {x: number}): { y: string } { z(); }\n"
    assert params(code, "typescript") == [(0, "a", "Map<K, V>"), (1, "b", "string"), (2, "...c", "number[]"), (0, "a", "{x: number}")]
    assert callees(code, "typescript") == ["y", "z"]


def test_go_declarations():
    code = """package m
import (
\t"fmt"
\tx "a/b"
)
type T struct { a int }
type (
\tU int
)
func (t *T) Do(a, b int, c ...string) (int, error) {
\tfmt.Println(f(a))
\tgo t.x.y(1)
}
func plain(int, string) {}
"""
    assert functions(code, "go") == [("Do", 2, "public", 10), ("plain", 2, "private", 14)]
    assert deps(code, "go") == [("fmt", "import", 2), ("a/b", "import", 2), ("T", "type", 6), ("(", "type", 7)]
    assert callees(code, "go") == ["fmt.Println", "f", "y"]
    assert params(code, "go")[:2] == [(0, "a", "int"), (1, "c", "string")]


def test_elixir_modules():
    code = """defmodule My.Mod do
  use GenServer, x: 1
  alias Foo.{A, B}
  require Logger
  def add(a, b \\\\ 1) do
    Repo.all(q(a))
    raise "x"
  end
  defp p(x) when x > 0, do: go(x)
  def f, do: 1
end
"""
    assert functions(code, "elixir") == [("add", 2, "public", 5), ("p(x) when x > 0", 0, "private", 9), ("f", 0, "public", 10)]
    assert deps(code, "elixir") == [("GenServer", "use", 2), ("Foo.{A, B}", "alias", 3)]
    assert callees(code, "elixir") == ["Repo.all", "q", "raise"]
    assert params(code, "elixir") == [] and modules(code, "elixir") == [("my_mod", "defmodule:My.Mod")]


def test_ruby_visibility():
    code = """require 'json'
class A < B
  include C, D
  def one(a, b = 1, *c, k: 2, &blk)
    foo(a).bar { |z| baz z }
    puts "x #{inter(a)}" if a
  end
  private
  def two; self.run(1); end
  def self.three(x) = x.y(1)
  protected :four
  def four
  end
  public
  def five
    if x then y(1) end
  end
  private :five
end
"""
    assert [f[:3] for f in functions(code, "ruby")] == [("one", 5, "public"), ("two", 0, "private"), ("three", 1, "public"), ("four", 0, "protected"), ("five", 0, "public")]
    assert deps(code, "ruby") == [("json", "require", 1), ("C,", "include", 3)]
    assert callees(code, "ruby") == ["bar", "foo", "baz", "puts", "inter", "run", "y", "y"]
    assert [p[1] for p in params(code, "ruby")] == ["a", "b", "c", "k", "blk", "x"]


def test_prolog_predicates():
    code = """:- module(m, [a/1, 'b'/2]).
:- use_module(library(lists)).
:- dynamic x/1.
a(X) :- b(X, Y), \\+ c(Y), ( d -> e ; !, f ), X = 1, m:g(X), Z is X + 1.
a([H|T]) :- a(T).
'$s'(X).
0.5::heads :- coin.
g --> "x", h, {i(1)}.
broken( :- .
last.
"""
    assert functions(code, "prolog") == [("a", 1, "public", 4), ("$s", 1, "private", 6), ("heads", 0, "private", 7), ("g", 0, "private", 8), ("last", 0, "private", 10)]
    assert [r["line"] for r in facts(code, "prolog") if r["predicate"] == "function_line" and r["func_id"] == "a_1"] == [4, 5]
    assert deps(code, "prolog") == [("lists", "use_module", 2)]
    assert callees(code, "prolog") == ["b", "c", "d", "e", "!", "f", "=", "g", "is", "a", "coin", "h", "i"]


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_long_files_take_time_in_proportion(language):
    """What stands before a call is read from the call backwards, not from the start of the file: 27 seconds before."""
    code = "".join(f"function f{k}(a) {{\n" + "  g.h(1);\n" * 30 + "  const x = async (b) => i(b);\n  // j(1)\n}\n" for k in range(256))
    started = time.process_time()
    rows = facts(code, language)
    assert time.process_time() - started < 8
    assert Counter(r["predicate"] for r in rows)["calls_external"] == 256 * 32


def test_calls_are_looked_for_only_where_wanted(monkeypatch):
    code = "import os\n\nclass A:\n    def f(self, x: int):\n        g(x).h()\n\ndef _k():\n    return f(1)\n"
    plain = lambda rows: [{k: v for k, v in r.items() if k != "seq"} for r in rows if r["predicate"] != "calls_external"]
    found = file_facts(code, "python", "a.py")
    assert any(r["predicate"] == "calls_external" for r in found)
    monkeypatch.setattr("factloom.lang.python_facts.CALLS.sites", None)
    fewer = file_facts(code, "python", "a.py", None, False)
    assert fewer and plain(fewer) == plain(found) and len(fewer) == len(plain(found))


@pytest.mark.parametrize("language", LANGUAGES)
def test_empty_files_have_a_module(language):
    assert [r["predicate"] for r in facts("", language)] == ["module"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abdef(){}[]:=>,.;\n \"'#/\\`|&<-!?@$%end do class def fn", max_size=120), st.sampled_from(LANGUAGES))
def test_parsers_never_fail(code, language):
    rows = facts(code, language)
    assert not [r for r in rows if r["predicate"] == "error"], rows[-1]
    for r in rows:
        if r["predicate"] == "calls_external" and language in ("python", "go", "javascript", "typescript"):
            assert "\n" not in r["called_func"] and "(" not in r["called_func"]


def test_python_agrees_with_the_standard_parser():
    code = open(ast.__file__, encoding="utf-8").read()
    tree = ast.parse(code)
    want = []

    def walk(node):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = child.args
                bare = bool(a.kwonlyargs and not a.vararg) + bool(a.posonlyargs)
                n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg) + bare
                want.append((child.name, n, child.lineno))
            else:
                walk(child)

    walk(tree)
    assert [(n, k, line) for n, k, _, line in functions(code, "python")] == sorted(want, key=lambda x: x[2])


def test_names():
    assert normalize_id("Foo::bar-Baz 9é") == "foo__bar_baz_9é"
    assert language_of("a/b.tsx") == "typescript" and language_of("x.PY") is None and language_of(".py") is None
    assert clean_param(" (a,\n  b) ") == "a, b" and len(clean_param("x" * 200)) == 80
    assert sanitize_callee("a.b\n .c(x)") == "c" and sanitize_callee("(f)") == "" and sanitize_callee(" g ") == "g"
