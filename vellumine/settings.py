"""Defaults in one place; each can be set by an environment variable VELLUMINE_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    branch_k: int = 15
    top_k: int = 10
    sibling_limit: int = 50
    change_k: int = 5
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    rrf_k: int = 60
    gate_low: float = 0.25
    gate_high: float = 0.70
    rerank: bool = True
    provider: str = "extractive"


def load() -> Settings:
    values = {}
    for f in fields(Settings):
        raw = os.environ.get(f"VELLUMINE_{f.name.upper()}")
        if raw is not None:
            kind = type(f.default)
            values[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
    return Settings(**values)
