"""Settings of a run, read from JSON with defaults, and the summary of a session."""

from __future__ import annotations

import json
import logging
import time
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

from vitaframe.operators.extract import CallPolicy


@dataclass(frozen=True)
class ModelConfig:
    """Which model answers and how. Values are checked on creation."""

    model: str = "stand-in"
    temperature: float = 0.0
    max_tokens: int = 2048
    tries: int = 5
    delay_s: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature must lie in [0, 2]")
        if self.max_tokens < 1 or self.tries < 1 or self.delay_s < 0:
            raise ValueError("max_tokens and tries must be positive, delay_s not negative")

    def policy(self) -> CallPolicy:
        return CallPolicy(delay_s=self.delay_s, tries=self.tries)


@dataclass(frozen=True)
class SubsetConfig:
    """A seeded subset of entities."""

    size: int = 20
    seed: int = 42

    def __post_init__(self) -> None:
        if self.size < 1 or self.seed < 0:
            raise ValueError("size must be positive and seed not negative")


@dataclass(frozen=True)
class RunConfig:
    model: ModelConfig = field(default_factory=ModelConfig)
    subset: SubsetConfig = field(default_factory=SubsetConfig)
    styles: Mapping[str, bool] = field(default_factory=lambda: {"direct": True, "pseudocode": True, "icl": True})

    def active_styles(self) -> list[str]:
        return [s for s, on in self.styles.items() if on]


def load_config(text: str) -> RunConfig:
    """From JSON, nested ({"model": {...}}) or flat; unknown keys are left out."""
    raw = json.loads(text)
    pick = lambda kind, own: kind(**{f.name: own[f.name] for f in fields(kind) if f.name in own})
    nested = lambda name: raw[name] if isinstance(raw.get(name), dict) else raw
    model, subset = nested("model"), nested("subset")
    return RunConfig(pick(ModelConfig, {k: v for k, v in model.items() if not isinstance(v, dict)}), pick(SubsetConfig, subset), raw.get("styles") or RunConfig().styles)


def summary(config: RunConfig, n_pages: int) -> str:
    return json.dumps(asdict(config) | {"pages": n_pages, "active_styles": config.active_styles()}, sort_keys=True)


def log_to_file(folder: str, level: int = logging.INFO) -> str:
    """Also writes the library's log to a new file in the folder, named by the time; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, time.strftime("vitaframe_%Y%m%d_%H%M%S.log"))
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
    handler.setLevel(level)
    logger().addHandler(handler)
    return path


def logger(name: str = "", level: int = logging.INFO) -> logging.Logger:
    """A logger below `vitaframe`, with one console handler at its root."""
    root = logging.getLogger("vitaframe")
    if not root.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        root.addHandler(handler)
        root.setLevel(level)
    return root.getChild(name) if name else root
