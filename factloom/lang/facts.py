"""Facts of one file in order of emission, as rows of one sparse schema."""

from __future__ import annotations

from .registry import Language, module_of, normalize_id

#: Columns of a fact row besides provenance; a predicate uses those of its relation.
COLUMNS = (
    "predicate", "seq", "module_id", "module_name", "filepath", "line", "func_id", "name", "arity", "visibility",
    "position", "type", "dep_name", "kind", "caller_id", "called_module", "called_func", "called_arity",
)


def clean_param(text: str) -> str:
    """One line, without commas and parentheses at the ends, at most 80 characters if it has over 80 bytes."""
    text = " ".join(text.split()).strip(",()")
    return text[:80] if len(text.encode()) > 80 else text


class Facts:
    def __init__(self, path: str, language: str, own: Language | None = None, with_calls: bool = True):
        """with_calls: whether calls are wanted; a parser needn't look for them otherwise."""
        self.rows: list[dict] = []
        self.with_calls = with_calls
        self.path, self.language = path, language
        self.module_id, self.module_name = module_of(path, language, own)
        self.module(self.module_id, self.module_name, path, 1)

    def add(self, predicate: str, **values) -> None:
        self.rows.append({"predicate": predicate, "seq": len(self.rows), **values})

    def module(self, module_id: str, name: str, filepath: str, line: int) -> None:
        self.add("module", module_id=module_id, module_name=name, filepath=filepath, line=line)

    def nested(self, label: str, name: str, line: int) -> str:
        """A module inside the file; returns its id."""
        module_id = normalize_id(name)
        self.module(module_id, name, f"{label}:{name}", line)
        return module_id

    def function(self, module_id: str, name: str, arity: int, visibility: str, line: int, params=(), prefix: str = "") -> str:
        func_id = normalize_id(f"{prefix}_{name}_{arity}" if prefix else f"{name}_{arity}")
        self.add("function", func_id=func_id, module_id=module_id, name=name, arity=arity, visibility=visibility, line=line)
        self.add("function_line", func_id=func_id, line=line)
        self.add("function_visibility", func_id=func_id, visibility=visibility)
        position = 0
        for param, kind in params:
            if param:
                self.add("function_param", func_id=func_id, position=position, name=param, type=kind or None)
                position += 1
        return func_id

    def depends(self, module_id: str, dep: str, kind: str, line: int) -> None:
        self.add("depends_on", module_id=module_id, dep_name=dep, kind=kind, line=line)

    def call(self, caller: str, callee: str, line: int) -> None:
        if self.with_calls:
            self.add("calls_external", caller_id=caller, called_module="unknown", called_func=callee, called_arity=0, line=line)
