"""Configuration from the environment: TIDELOG_<COMPONENT>[_<NAMESPACE>]__<VARIABLE>."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Any

from tidelog.errors import ConfigError

BLOOM_FPR = 0.0001
SPARSE_STRIDE = 4


def _bool(text: str) -> bool:
    return text.lower() in ("true", "1")


def _unsigned(bits: int):
    def parse(text: str) -> int:
        if not text.isascii() or not text.isdigit() or int(text) >= 1 << bits:
            raise ValueError(f"not an unsigned {bits}-bit number")
        return int(text)

    parse.__name__ = f"u{bits}"
    return parse


def variable(component: str, name: str, namespace: str = "") -> str:
    return f"TIDELOG_{component}{'_' + namespace if namespace else ''}__{name}".upper()


def setting(component: str, name: str, default: Any, parse=str, namespace: str = "") -> Any:
    """The parsed value, or the default where the variable is unset. A value that doesn't parse raises ConfigError."""
    full = variable(component, name, namespace)
    if (text := os.environ.get(full)) is None:
        return default
    try:
        return parse(text)
    except ValueError as e:
        raise ConfigError(f"{full}={text!r}: {parse.__name__.lstrip('_')}: {e}") from e


@dataclass(frozen=True)
class Config:
    capacity: int = 1024
    compaction_enabled: bool = True
    compaction_interval_seconds: int = 600
    port: int = 6210
    path: str = "./data"

    @classmethod
    def from_env(cls) -> Config:
        return cls(
            setting("engine", "capacity", cls.capacity, _unsigned(64), "memtable"),
            setting("engine", "compaction_enabled", cls.compaction_enabled, _bool, "store"),
            setting("engine", "compaction_interval_seconds", cls.compaction_interval_seconds, _unsigned(64), "store"),
            setting("kv", "port", cls.port, _unsigned(16)),
            setting("kv", "path", cls.path),
        )
