"""Settings of the engine; every one can be overridden by an environment variable of the same name in capitals with PLANWEAVE_ before it."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    group_size: int = 12
    chunk_tokens: int = 700
    overlap_tokens: int = 150
    paragraph_tokens: int = 1024
    chars_per_token: int = 2
    embedding_batch: int = 64
    embedding_dim: int = 512
    neighbours: int = 64
    alias_similarity: float = 0.86
    entailment: float = 0.85
    bridge_confidence: float = 0.85
    relation_confidence: float = 0.5
    pattern_confidence: float = 0.6
    search_threshold: float = 0.6

    @classmethod
    def from_env(cls) -> EngineConfig:
        given = {}
        for f in fields(cls):
            value = os.environ.get(f"PLANWEAVE_{f.name.upper()}")
            if value is not None:
                given[f.name] = type(f.default)(value)
        return cls(**given)


DEFAULT = EngineConfig()
