"""Settings: nested dataclasses with defaults, merge, validation, JSON files and callbacks."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class CacheSettings:
    max_entries: int = 1000
    max_bytes: int = 100 * 1024 * 1024
    ttl_ms: int = 24 * 3600 * 1000
    min_relevance: float = 0.1
    policy: str = "lru"


@dataclass(frozen=True)
class BudgetSettings:
    max_tokens: int = 1000
    chars_per_token: int = 4
    context_lines: int = 3


@dataclass(frozen=True)
class PathSettings:
    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    cache: CacheSettings = field(default_factory=CacheSettings)
    budget: BudgetSettings = field(default_factory=BudgetSettings)
    paths: PathSettings = field(default_factory=PathSettings)
    log_level: str = "info"

    def merged(self, changes: dict) -> Settings:
        """A new, valid set of settings; the old one stays as it is where the changes are not valid."""
        new = _merge(self, changes)
        if problems := new.problems():
            raise ValueError("; ".join(problems))
        return new

    def problems(self) -> list[str]:
        rules = [
            (self.cache.max_entries > 0, "cache.max_entries must be positive"), (self.cache.max_bytes > 0, "cache.max_bytes must be positive"), (self.cache.ttl_ms > 0, "cache.ttl_ms must be positive"),
            (0 <= self.cache.min_relevance <= 1, "cache.min_relevance must be between 0 and 1"), (self.cache.policy in ("lru", "lfu", "ttl", "fifo"), "cache.policy must be lru, lfu, ttl or fifo"),
            (self.budget.max_tokens > 0 and self.budget.chars_per_token > 0, "budget figures must be positive"), (self.log_level in ("debug", "info", "warn", "error"), "log_level must be debug, info, warn or error"),
        ]
        return [text for ok, text in rules if not ok]

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings of a JSON file; the defaults are written where there is none."""
        if not Path(path).exists():
            cls().save(path)
        return cls().merged(json.loads(Path(path).read_text()))


def _merge(old, changes: dict):
    known = {f.name: getattr(old, f.name) for f in fields(old)}
    if unknown := set(changes) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    values = {k: _merge(known[k], v) if is_dataclass(known[k]) else tuple(v) if isinstance(known[k], tuple) else v for k, v in changes.items()}
    return replace(old, **values)


class Store:
    """Current settings, with callbacks that hear of changes."""

    def __init__(self, settings: Settings | None = None):
        self.initial = self.current = settings or Settings()
        self.callbacks: list[Callable[[Settings], None]] = []

    def update(self, changes: dict) -> Settings:
        self.current = self.current.merged(changes)
        for f in self.callbacks:
            f(self.current)
        return self.current

    def reset(self) -> Settings:
        self.current = self.initial
        return self.current


class JsonLines(logging.Formatter):
    """Log records as JSON lines."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname.lower(), "message": record.getMessage()})
