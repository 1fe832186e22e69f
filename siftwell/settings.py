"""The settings that operators take their defaults from, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    min_tokens: int = 10
    max_tokens: int = 512
    overlap: int = 50
    merge_below: int = 50
    semantic_candidates: int = 20
    keyword_candidates: int = 15
    top_k: int = 10
    rrf_k: int = 20
    alpha: float = 0.8
    context_tokens: int = 3_000
    history: int = 6
    message_chars: int = 2_000
    chunker: str = "section_aware"
    embedder: str = "hashing"
    dimension: int = 64


DEFAULTS = Settings()
