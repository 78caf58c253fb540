"""The strategies, their content types and their default grids."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import product
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunkers import BUILT_IN, SEPARATORS, Kernel
from ..operators.kernels import Span
from ..schema import Config

TEXTS = ("text", "markdown", "html")
_KINDS = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array"}


@runtime_checkable
class Chunking(Protocol):
    """What a strategy of the caller's own has: names, content types, parameters, a grid, and ``chunk``, which runs in the executors."""

    name: str
    types: tuple[str, ...]
    params: tuple[str, ...]
    grid: tuple[dict[str, Any], ...]

    def chunk(self, text: str, params: Mapping[str, Any], ends: list[int]) -> Iterator[Span]: ...


@dataclass(frozen=True)
class Strategy:
    name: str
    types: tuple[str, ...]
    params: tuple[str, ...]
    grid: tuple[dict[str, Any], ...] = field(hash=False, default=())
    says: str = ""
    #: (text, parameters, token ends) to spans; built-in strategies need none.
    chunk: Kernel | None = field(hash=False, default=None)


def _grid(**values: tuple) -> tuple[dict[str, Any], ...]:
    return tuple(dict(zip(values, combination, strict=True)) for combination in product(*values.values()))


# Names, content types, parameters and grids.
_KNOWN = (
    Strategy("fixed_tokens", TEXTS, ("max_tokens", "overlap_tokens"), _grid(max_tokens=(256, 512, 1024), overlap_tokens=(0, 50, 100)), says="Windows of a fixed number of tokens"),
    Strategy(
        "recursive_character", TEXTS, ("chunk_size_chars", "chunk_overlap_chars", "separators"),
        _grid(chunk_size_chars=(800, 1600, 3200), chunk_overlap_chars=(0, 100, 200)), says="Windows of characters, each cut at the strongest separator it holds"),
    Strategy(
        "semantic", TEXTS, ("max_tokens", "overlap_tokens", "similarity_threshold", "min_tokens"),
        _grid(max_tokens=(256, 512, 1024), overlap_tokens=(0, 50)), says="Pieces within a token budget, cut at the strongest boundaries"),
    Strategy("markdown_semantic", ("markdown",), ("max_tokens", "overlap_tokens"), _grid(max_tokens=(256, 512)), says="Sections by headings, each cut within a token budget"),
    Strategy("pdf_structural", ("pdf", "markdown", "html"), ("max_region_chars",), _grid(max_region_chars=(2000, 4000, 8000)), says="Pages or sections, cut at a number of characters"),
    Strategy(
        "structural_semantic", ("pdf", "docx", "pptx", "markdown"), ("max_tokens", "overlap_tokens", "max_region_chars"), _grid(max_tokens=(256, 512)), says="Token windows within pages or sections"),
    Strategy("late_chunking", ("text", "markdown"), ("chunk_size_tokens", "max_tokens", "overlap_tokens"), _grid(chunk_size_tokens=(256, 512)), says="Token windows whose vectors come from the whole document"),
    Strategy("code_ast", ("code",), ("max_tokens", "overlap_lines", "merge_small"), _grid(max_tokens=(256, 512)), says="Top-level functions and classes"),
    Strategy("code_window", ("code",), ("max_tokens", "overlap_lines"), _grid(max_tokens=(256, 512, 1024)), says="Whole lines within a token budget"),
    Strategy("agentic", ("text", "markdown"), ("model", "max_propositions", "chunk_size_chars", "chunk_overlap_chars"), _grid(max_propositions=(30,)), says="Spans that a language model proposed, else separators"),
)


class Registry:
    """Strategies by name; a name registered again is replaced."""

    def __init__(self) -> None:
        self._held = {s.name: s for s in _KNOWN}

    def register(self, strategy: Strategy | Chunking) -> None:
        """A strategy that isn't built in must have ``chunk``."""
        if strategy.name not in BUILT_IN and not callable(getattr(strategy, "chunk", None)):
            raise TypeError(f"{strategy.name} has no chunk")
        self._held[strategy.name] = strategy

    def kernels(self) -> dict[str, Kernel]:
        """The callables of strategies that bring their own."""
        return {n: s.chunk for n, s in self._held.items() if getattr(s, "chunk", None) is not None}

    def table(self, spark: SparkSession, content_type: str | None = None) -> DataFrame:
        """(strategy, description, content_types, params_schema, grid_points) of all strategies, or of those for a content type."""
        rows = []
        for name in self.names(content_type):
            s = self._held[name]
            known = {p: next((_KINDS[type(g[p])] for g in s.grid if p in g), "any") for p in s.params}
            rows.append((name, getattr(s, "says", "") or (s.__doc__ or ""), list(s.types), json.dumps(known, sort_keys=True, separators=(",", ":")), len(s.grid)))
        return spark.createDataFrame(rows, "strategy string, description string, content_types array<string>, params_schema string, grid_points int")

    def selected(self, names: str | None = None, all_text: bool = False, agentic: bool = False) -> list[str]:
        """Strategies to run: a comma-separated list, or all for text (``agentic``, which asks a model, only if wanted), or the two plain ones."""
        if names:
            found = [n.strip() for n in names.split(",") if n.strip()]
            if unknown := [n for n in found if n not in self._held]:
                raise KeyError(f"unknown strategies: {unknown}; there are {sorted(self._held)}")
            return found
        if all_text:
            return [n for n in self.names("text") if agentic or n != "agentic"]
        return ["fixed_tokens", "recursive_character"]

    def availability(self, spark: SparkSession, chosen: list[str], content_type: str) -> DataFrame:
        """(strategy, chosen, note) of all strategies for a content type."""
        notes = {"agentic": "asks a language model", "fixed_tokens": "baseline"}
        return spark.createDataFrame([(n, n in chosen, notes.get(n, "")) for n in self.names(content_type)], "strategy string, chosen boolean, note string")

    def get(self, name: str) -> Strategy:
        return self._held[name]

    def names(self, content_type: str | None = None) -> list[str]:
        return [s.name for s in self._held.values() if content_type is None or content_type in s.types]

    def configs(self, content_type: str, names: list[str] | None = None, baseline: bool = True) -> list[Config]:
        """The baseline first, then every grid point of the strategies that fit; a point equal to the baseline comes once."""
        if unknown := set(names or ()) - set(self._held):
            raise KeyError(f"unknown strategies: {sorted(unknown)}")
        out = []
        if baseline and content_type in self._held["fixed_tokens"].types:
            out.append(Config("fixed_tokens", {"max_tokens": 512, "overlap_tokens": 0}))
        for name in self.names(content_type):
            if names is None or name in names:
                out += [c for g in self._held[name].grid if (c := Config(name, g)) not in out]
        return out

    def check(self, config: Config) -> Config:
        if unknown := set(config.params) - set(self.get(config.strategy).params):
            raise ValueError(f"{config.strategy} has no parameters {sorted(unknown)}")
        return config


REGISTRY = Registry()


def params_label(config: Config) -> str:
    """The parameters of a configuration for people; the formats are fixed values."""
    p = config.params
    overlap = p.get("overlap_tokens", 0)
    match config.strategy:
        case "fixed_tokens":
            return f"{p.get('max_tokens', '?')} tok / {overlap} ov"
        case "recursive_character":
            other = " own-sep" if p.get("separators") not in (None, SEPARATORS) else ""
            return f"{p.get('chunk_size_chars', '?')} chr / {p.get('chunk_overlap_chars', 0)} ov{other}"
        case "late_chunking":
            return f"{p.get('chunk_size_tokens', '?')} tok / {overlap} ov"
        case "semantic":
            return f"{p.get('max_tokens', '?')} tok / thr={p.get('similarity_threshold', 0):.2f}"
        case "agentic":
            return f"{p.get('model', '?')} / {p.get('max_propositions', '?')} props"
    return config.params_json


def label_column(configs: list[Config], config_id: str = "config_id") -> Column:
    """``params_label`` of a column of configuration ids."""
    return F.element_at(F.create_map(*(F.lit(x) for c in configs for x in (c.id, params_label(c)))), F.col(config_id))


def generation_gate(judge: str, keys: list[str], env: Mapping[str, str]) -> tuple[bool, str]:
    """Whether generation can be judged: (yes, why not): the judge's library must be there and one of the keys be set."""
    if importlib.util.find_spec(judge) is None:
        return False, f"{judge} is not installed"
    if not any(env.get(k) for k in keys):
        return False, f"none of {', '.join(keys)} is set"
    return True, ""
