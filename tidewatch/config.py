"""The engine's configuration: which windows and rules, how late events are treated, variables."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass

from .lang.ast import WindowSchema
from .lang.tokens import seconds
from .operators.match import memory
from .streaming.late import POLICIES

MODES = ("local", "replicated", "partitioned")


@dataclass(frozen=True)
class WindowConfig:
    name: str
    mode: str
    partition_key: str | None
    over_cap: float
    max_bytes: int
    watermark: float
    allowed_lateness: float
    late_policy: str


@dataclass(frozen=True)
class Config:
    schemas: str
    rules: str
    windows: dict[str, WindowConfig]
    variables: dict[str, str]
    sinks: str


def load(text: str) -> Config:
    """The configuration of a TOML text; windows take what they do not set from [window_defaults]."""
    spec = tomllib.loads(text)
    defaults = spec.get("window_defaults", {})
    windows = {}
    for name, own in spec.get("window", {}).items():
        get = lambda key, other, own=own: own.get(key, defaults.get(key, other))
        w = WindowConfig(
            name, own.get("mode", "local"), own.get("partition_key"), seconds(own["over_cap"]), memory(get("max_window_bytes", "256MB")), seconds(get("watermark", "5s")), seconds(get("allowed_lateness", "0s")), get("late_policy", "drop"),
        )
        if w.mode not in MODES:
            raise ValueError(f"window {name}: unknown mode {w.mode}")
        if w.mode == "partitioned" and not w.partition_key:
            raise ValueError(f"window {name}: a partitioned window needs a partition_key")
        if w.late_policy not in POLICIES:
            raise ValueError(f"window {name}: unknown late policy {w.late_policy}")
        if w.max_bytes > memory(defaults.get("max_total_bytes", "2GB")):
            raise ValueError(f"window {name}: max_window_bytes is over max_total_bytes")
        windows[name] = w
    for key in spec.get("vars", {}):
        if not re.fullmatch(r"[A-Za-z_]\w*", key, re.ASCII):
            raise ValueError(f"bad variable name {key!r}")
    runtime = spec.get("runtime", {})
    if runtime.get("executor_parallelism", 1) <= 0:
        raise ValueError("executor_parallelism must be positive")
    if not spec.get("sinks", "sinks"):
        raise ValueError("sinks must name a folder")
    return Config(runtime.get("schemas", ""), runtime.get("rules", ""), windows, {k: str(v) for k, v in spec.get("vars", {}).items()}, spec.get("sinks", "sinks"))


def check_retention(config: Config, schemas: Mapping[str, WindowSchema]) -> None:
    """Every declared window must be configured, and may keep its events no longer than its cap."""
    for name, schema in schemas.items():
        w = config.windows.get(name)
        if w is None:
            raise ValueError(f"window {name} is declared but not configured")
        if schema.over > w.over_cap:
            raise ValueError(f"window {name}: over ({schema.over:g} s) is more than over_cap ({w.over_cap:g} s)")
