"""Configuration: frozen, checked, from TOML or JSON; unknown keys are errors."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Retry:
    retries: int = 3
    wait: float = 1.0
    most: float = 60.0


@dataclass(frozen=True)
class Quality:
    min_length: int = 100
    min_words: int = 10
    languages: tuple[str, ...] = ()
    duplicates: bool = True


@dataclass(frozen=True)
class Crawl:
    seeds: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    subdomains: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    max_pages: int = 1000
    max_depth: int = 10
    robots: str = "strict"
    robots_allow: tuple[str, ...] = ()
    delay: float = 0.5
    retry: Retry = field(default_factory=Retry)
    quality: Quality = field(default_factory=Quality)

    def __post_init__(self):
        if not 0 < self.max_pages or self.max_depth < 0:
            raise ValueError("max_pages must be positive and max_depth not negative")
        if self.robots not in ("strict", "off", "allowlist"):
            raise ValueError("robots must be strict, off or allowlist")


@dataclass(frozen=True)
class Sync:
    site_id: str = ""
    strategies: tuple[str, ...] = ("sitemap", "headers", "hash")
    max_age_hours: float | None = None
    max_pages: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    noise: tuple[str, ...] | None = None
    deletion_threshold: int = 2

    def __post_init__(self):
        known = {"sitemap", "headers", "hash", "all"}
        if bad := set(self.strategies) - known:
            raise ValueError(f"unknown strategies {sorted(bad)}")

    def expanded(self) -> tuple[str, ...]:
        return ("sitemap", "headers", "hash") if "all" in self.strategies else self.strategies


@dataclass(frozen=True)
class Output:
    mode: str = "multi"
    root: str = "output"
    deletion: str = "tombstone"


def build(kind: type, values: dict[str, Any]):
    """An instance from plain values, nested ones too; lists become tuples."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown keys of {kind.__name__}: {sorted(unknown)}")
    inner = {"retry": Retry, "quality": Quality}
    return kind(**{k: build(inner[k], v) if isinstance(v, dict) and k in inner else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(kind: type, path: str | Path):
    text = Path(path).read_text(encoding="utf-8")
    return build(kind, tomllib.loads(text) if str(path).endswith(".toml") else json.loads(text))


class UserConfig:
    """Defaults of a user in a JSON file; a missing or broken file means the defaults."""

    DEFAULTS = {"store": "quern-store", "max_pages": 100, "max_depth": 5, "robots": "strict", "output": "output"}

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> dict[str, Any]:
        try:
            found = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            found = {}
        return self.DEFAULTS | {k: v for k, v in found.items() if k in self.DEFAULTS}

    def set(self, key: str, value: Any) -> None:
        if key not in self.DEFAULTS:
            raise KeyError(key)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.load() | {key: type(self.DEFAULTS[key])(value)}, indent=2), encoding="utf-8")

    def reset(self) -> None:
        self.path.unlink(missing_ok=True)
