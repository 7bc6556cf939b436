"""Parsers of source code, one for each language. None of them fails on broken code."""

from __future__ import annotations

from . import ecma_facts, elixir_facts, go_facts, prolog_facts, python_facts, ruby_facts, rust_facts
from .facts import COLUMNS, Facts
from .registry import LANGUAGES, Language, language_of, own_languages, register_language, remove_language

EXTRACT = {
    "python": python_facts.extract,
    "rust": rust_facts.extract,
    "typescript": ecma_facts.extract,
    "javascript": ecma_facts.extract,
    "go": go_facts.extract,
    "elixir": elixir_facts.extract,
    "ruby": ruby_facts.extract,
    "prolog": prolog_facts.extract,
}


def file_facts(code: str, language: str, path: str, own: dict[str, Language] | None = None, with_calls: bool = True) -> list[dict]:
    """The facts of one file; where a parser gives up, those found so far and one of predicate `error`.

    own: languages of users, by name, where this process may not have them registered. with_calls: whether
    calls are wanted; the places of the others among the facts (seq) leave no room for them otherwise."""
    added = (own_languages() if own is None else own).get(language)
    facts = Facts(path, language, added, with_calls)
    try:
        (added.extract() if added else EXTRACT[language])(code, facts)
    except Exception as e:  # noqa: BLE001  the facts found so far stand
        facts.add("error", name=f"{type(e).__name__}: {e}"[:200], line=1)
    return facts.rows


__all__ = ["COLUMNS", "LANGUAGES", "Language", "file_facts", "language_of", "own_languages", "register_language", "remove_language"]
