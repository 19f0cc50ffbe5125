"""Settings of the operators: defaults, a file, the environment, then the session (SC13).

A later source wins.  A key that no section has, or a value out of bounds, raises.
"""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from loomline.operators import compress, tools

PREFIX = "loomline"


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


@dataclass(frozen=True)
class Compression:
    min_tokens: int = compress.LEAST
    max_tokens: int = compress.MOST
    refusal_threshold: float = compress.REFUSAL
    compressor: str = "lint"

    def __post_init__(self) -> None:
        _need(0 <= self.min_tokens < self.max_tokens, "compression: 0 <= min_tokens < max_tokens")
        _need(0 <= self.refusal_threshold <= 1, "compression: refusal_threshold is a share")
        _need(self.compressor in compress.COMPRESSORS, f"compression: compressor is one of {sorted(compress.COMPRESSORS)}")


@dataclass(frozen=True)
class ToolSelection:
    top_k: int = tools.TOP_K
    k_max: int = tools.SESSION_K
    mcp_signal_threshold: float = tools.MCP_THRESHOLD

    def __post_init__(self) -> None:
        _need(self.top_k > 0 and self.k_max > 0, "tool_selection: top_k and k_max are positive")


@dataclass(frozen=True)
class History:
    enabled: bool = True
    keep_recent_turns: int = 4
    context_threshold: float = 0.8
    context_window: int = 200_000

    def __post_init__(self) -> None:
        _need(self.keep_recent_turns >= 1, "history: keep_recent_turns is at least 1")
        _need(0 < self.context_threshold <= 1, "history: context_threshold is a share above 0")
        _need(self.context_window > 0, "history: context_window is positive")


@dataclass(frozen=True)
class Store:
    path: str = ""
    ttl_seconds: int | None = None

    def __post_init__(self) -> None:
        _need(self.ttl_seconds is None or self.ttl_seconds > 0, "store: ttl_seconds is positive or absent")


@dataclass(frozen=True)
class Settings:
    compression: Compression = field(default_factory=Compression)
    tool_selection: ToolSelection = field(default_factory=ToolSelection)
    history: History = field(default_factory=History)
    store: Store = field(default_factory=Store)

    def merged(self, given: Mapping[str, Mapping[str, Any]]) -> Settings:
        """These settings with those of a mapping of sections; unknown sections and keys raise."""
        sections = {f.name for f in dataclasses.fields(self)}
        changed = {}
        for section, values in given.items():
            _need(section in sections, f"unknown section '{section}'; there are {sorted(sections)}")
            _need(isinstance(values, Mapping), f"section '{section}' is no mapping")
            own = getattr(self, section)
            kinds = {f.name: f.type for f in dataclasses.fields(own)}
            for key in values:
                _need(key in kinds, f"unknown key '{key}' in '{section}'; there are {sorted(kinds)}")
            changed[section] = dataclasses.replace(own, **{k: _typed(v, kinds[k], f"{section}.{k}") for k, v in values.items()})
        return dataclasses.replace(self, **changed)


def _typed(value: Any, kind: str, key: str) -> Any:
    """A value of a file as it is; text of the environment or the session in the type of its key."""
    if value is None or isinstance(value, str) and not value and "None" in kind:
        _need("None" in kind, f"{key} needs a value")
        return None
    if kind == "bool" and isinstance(value, str):
        low = value.strip().lower()
        _need(low in ("1", "true", "yes", "0", "false", "no"), f"{key} is true or false, not '{value}'")
        return low in ("1", "true", "yes")
    base = {"bool": bool, "str": str, "float": float}.get(kind, int)
    _need(base is bool or not isinstance(value, bool), f"{key} is no flag")
    try:
        cast = base(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{key}: '{value}' is no {base.__name__}") from e
    _need(isinstance(value, str) or cast == value, f"{key}: {value!r} is no {base.__name__}")
    return cast


def _sections(flat: Mapping[str, str], separator: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for name, value in flat.items():
        section, _, key = name.partition(separator)
        out.setdefault(section, {})[key] = value
    return out


def from_file(path: str) -> dict:
    """Sections of a JSON file, or of a YAML file where PyYAML is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def load(path: str | None = None, environ: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> Settings:
    """Defaults, then the file if it is there, then ``LOOMLINE_<SECTION>__<KEY>`` of the
    environment, then ``loomline.<section>.<key>`` of the session's configuration."""
    settings = Settings()
    if path and os.path.exists(path):
        settings = settings.merged(from_file(path))
    head = f"{PREFIX.upper()}_"
    named = {k[len(head) :].lower(): v for k, v in (os.environ if environ is None else environ).items() if k.startswith(head) and "__" in k}
    settings = settings.merged(_sections(named, "__"))
    if spark is not None:
        own = {k[len(PREFIX) + 1 :]: v for k, v in spark.conf.getAll.items() if k.startswith(f"{PREFIX}.")}
        settings = settings.merged(_sections(own, "."))
    return settings
