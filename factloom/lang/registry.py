"""Languages, their file extensions and how modules are named; and languages that users add.

A language of one's own is known where it was registered, and travels from there with the plans that
are made: its parser as a serialised function, its extensions as an option of the sources.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

#: extension, language, separator of module names, suffixes that are stripped in turn. Fixed values.
EXTENSIONS = (
    ("rs", "rust", "::", (".rs",)),
    ("py", "python", ".", (".py",)),
    ("pyw", "python", ".", (".py",)),
    ("ts", "typescript", ".", (".js", ".ts", ".jsx", ".tsx")),
    ("tsx", "typescript", ".", (".js", ".ts", ".jsx", ".tsx")),
    ("js", "javascript", ".", (".js", ".ts", ".jsx", ".tsx")),
    ("jsx", "javascript", ".", (".js", ".ts", ".jsx", ".tsx")),
    ("go", "go", ".", (".go",)),
    ("ex", "elixir", ".", (".ex",)),
    ("exs", "elixir", ".", (".ex",)),
    ("rb", "ruby", "::", (".rb",)),
    ("rake", "ruby", "::", (".rb",)),
    ("gemspec", "ruby", "::", (".rb",)),
    ("pl", "prolog", ":", (".pl",)),
    ("plt", "prolog", ":", (".pl",)),
    ("pro", "prolog", ":", (".pl",)),
    ("prolog", "prolog", ":", (".pl",)),
)
LANGUAGE_OF = {e: language for e, language, _, _ in EXTENSIONS}
NAMING = {language: (separator, suffixes) for _, language, separator, suffixes in EXTENSIONS}
LANGUAGES = tuple(dict.fromkeys(LANGUAGE_OF.values()))


def extension(path: str) -> str | None:
    """What follows the last dot of the file's name; a name that starts with its only dot has none."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem else None


@dataclass(frozen=True)
class Language:
    """A language of one's own. parser: extract(code, facts) as in this package, serialised."""

    name: str
    extensions: tuple[str, ...]
    separator: str
    suffixes: tuple[str, ...]
    parser: bytes

    def extract(self) -> Callable:
        return _loaded(self.parser)


@cache
def _loaded(parser: bytes) -> Callable:
    from pyspark import cloudpickle

    return cloudpickle.loads(parser)


_own: dict[str, Language] = {}


def register_language(name: str, extensions: tuple[str, ...], extract: Callable, separator: str = ".", suffixes: tuple[str, ...] | None = None) -> Language:
    """Adds a language, or replaces one's own of that name; plans that are made from now on know it.

    extract(code, facts) adds what it finds by the methods of Facts. suffixes are stripped from paths for
    the names of modules, by default all extensions. The function travels by value, with the module that
    defines it, unless that module belongs to this package.
    """
    from pyspark import cloudpickle

    if name in LANGUAGES or any(LANGUAGE_OF.get(e) or any(e in o.extensions for o in _own.values() if o.name != name) for e in extensions):
        raise ValueError(f"the language {name!r} or one of its extensions is taken")
    module = sys.modules.get(getattr(extract, "__module__", None) or "")
    by_value = module is not None and module.__name__ != "__main__" and not module.__name__.startswith(__name__.split(".")[0] + ".")
    if by_value:
        cloudpickle.register_pickle_by_value(module)
    try:
        parser = cloudpickle.dumps(extract)
    finally:
        if by_value:
            cloudpickle.unregister_pickle_by_value(module)
    _own[name] = Language(name, tuple(extensions), separator, tuple(suffixes if suffixes is not None else (f".{e}" for e in extensions)), parser)
    return _own[name]


def remove_language(name: str) -> None:
    _own.pop(name, None)


def own_languages() -> dict[str, Language]:
    return dict(_own)


def own_extensions() -> str:
    """Extensions of users' languages, for the option `languages` of the sources."""
    return json.dumps({e: o.name for o in _own.values() for e in o.extensions})


def all_extensions() -> dict[str, str]:
    return LANGUAGE_OF | {e: o.name for o in _own.values() for e in o.extensions}


def naming(language: str) -> tuple[str, tuple[str, ...]]:
    return NAMING[language] if language in NAMING else (_own[language].separator, _own[language].suffixes)


def language_of(path: str, own: dict[str, str] | None = None) -> str | None:
    """own: extensions of users' languages, where the process isn't the one that registered them."""
    ext = extension(path) or ""
    return LANGUAGE_OF.get(ext) or (all_extensions() if own is None else own).get(ext)


def extensions_of(language: str) -> list[str]:
    return [e for e, of, _, _ in EXTENSIONS if of == language]


def normalize_id(name: str) -> str:
    """Every character that is neither a letter, a digit nor `_` becomes `_`; letters become lower case."""
    return "".join(c.lower()[:1] if c.isalnum() or c == "_" else "_" for c in name)


def module_of(path: str, language: str, own: Language | None = None) -> tuple[str, str]:
    """(module_id, module_name) of a file; suffixes are stripped as often as they stand at the end."""
    separator, suffixes = (own.separator, own.suffixes) if own else naming(language)
    for suffix in suffixes:
        while path.endswith(suffix):
            path = path[: -len(suffix)]
    name = path.replace("/", separator).replace("\\", separator)
    return normalize_id(name), name
