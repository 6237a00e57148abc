"""Tunables of the engine, in one immutable value."""

from __future__ import annotations

from dataclasses import dataclass

#: Retrieval configurations, in reporting order, and the two collections.
CONFIGS = ("dense", "hybrid", "hybrid_rerank", "hybrid_rerank_filter")
ALL_CONFIGS = (*CONFIGS, "hybrid_filter")
COLLECTIONS = ("recursive", "section_aware")


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000  # characters, not tokens
    chunk_overlap: int = 150
    min_section_chars: int = 200
    min_chunk_chars: int = 100
    rrf_k: int = 60
    candidate_pool: int = 20
    top_k: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    numeric_tolerance: float = 0.02
    #: A table of queries up to this many rows is broadcast; larger ones are joined by shuffle.
    broadcast_queries: int = 100_000


DEFAULTS = Settings()
