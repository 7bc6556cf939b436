"""Settings of the command line: a TOML file, overridden by the environment, overridden by arguments."""

from __future__ import annotations

import json
import os
import tomllib
import warnings
from dataclasses import asdict, dataclass, field

ENVIRONMENT = "FACTLOOM_STORE"


@dataclass
class Config:
    store: str | None = None
    repo_id: str | None = None
    ignore_patterns: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        """Defaults where there is no file; also, with a warning, where it can't be read."""
        try:
            with open(path, "rb") as f:
                found = tomllib.load(f)
            return cls(**{k: v for k, v in found.items() if k in cls.__dataclass_fields__})
        except FileNotFoundError:
            return cls()
        except (OSError, tomllib.TOMLDecodeError, TypeError) as e:
            warnings.warn(f"{path}: {e}", stacklevel=2)
            return cls()

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(f"{k} = {json.dumps(v)}\n" for k, v in asdict(self).items() if v is not None)

    def resolve_store(self, argument: str | None = None) -> str | None:
        return argument or os.environ.get(ENVIRONMENT) or self.store
