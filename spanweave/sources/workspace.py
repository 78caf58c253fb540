"""Settings of a workspace: a YAML file, the environment, and defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

FILE = ".spanweave.yaml"
FORMATS = ("json", "yaml", "table")
#: Variables of the environment that stand in for settings.
BASE_VARIABLE, KEY_VARIABLE, CACHE_VARIABLE = "SPANWEAVE_API_BASE", "SPANWEAVE_API_KEY", "SPANWEAVE_CACHE_DIR"


def parse_yaml(text: str) -> Any:
    """What a YAML text says; JSON is YAML too, so without the library that much is read."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text) if text.strip() else None
    return yaml.safe_load(text)


def as_yaml(value: Any) -> str:
    try:
        import yaml
    except ImportError:
        import json

        return json.dumps(value, indent=2, default=str) + "\n"
    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


@dataclass(frozen=True)
class Workspace:
    embedding_model: str | None = None
    llm_model: str | None = None
    api_base: str | None = None
    api_key: str | None = field(default=None, repr=False)
    use_case: str = "rag_qa"
    max_docs: int = 100
    context_budget_tokens: int = 2000
    cache_dir: str | None = None
    strip_patterns: tuple[str, ...] = ()

    @staticmethod
    def read(path: str | Path | None = None, folder: str | Path = ".") -> Workspace:
        """From ``path``, else from the file in ``folder``; defaults if there is none, an error for settings that don't exist."""
        where = Path(path) if path is not None else Path(folder) / FILE
        if not where.is_file():
            return Workspace()
        given = parse_yaml(where.read_text()) or {}
        if unknown := set(given) - {f.name for f in fields(Workspace)}:
            raise ValueError(f"{where} has unknown settings: {sorted(unknown)}")
        return Workspace(**given | ({"strip_patterns": tuple(given["strip_patterns"])} if "strip_patterns" in given else {}))

    @staticmethod
    def write_defaults(folder: str | Path = ".") -> Path:
        """A new file with all settings but keys; one that is there is not touched."""
        where = Path(folder) / FILE
        if where.exists():
            raise FileExistsError(f"{where} is there already")
        settings = asdict(Workspace()) | {"strip_patterns": []}
        del settings["api_key"]
        where.write_text(as_yaml(settings))
        return where

    def provider(self, env: Mapping[str, str] = os.environ) -> tuple[str | None, str | None]:
        """(base address, key): the workspace's own, else those of the environment."""
        return self.api_base or env.get(BASE_VARIABLE) or None, self.api_key or env.get(KEY_VARIABLE) or None

    def cache(self, env: Mapping[str, str] = os.environ) -> str:
        """Where caches are kept: by the environment, the workspace, or the home folder.  On a cluster this names a shared store."""
        return env.get(CACHE_VARIABLE) or self.cache_dir or str(Path.home() / ".cache" / "spanweave")


def checked_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown output format {name!r}; there are {', '.join(FORMATS)}")
    return name
