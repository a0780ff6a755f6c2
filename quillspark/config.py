"""All thresholds in one frozen object, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # fixed values of the retrieval model
    k1: float = 1.5
    b: float = 0.75
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    question_weight: float = 0.28
    both_bonus: float = 0.06
    dense_floor: float = 0.18
    question_boost: float = 1.5
    rrf_k: int = 60
    # gates
    score_floor: float = 1.5
    relative_floor: float = 0.55
    anchor_share: float = 0.30
    anchor_pool: int = 30
    coverage_share: float = 0.5
    rerank_floor: float = 0.75
    heavy_rerank_floor: float = 0.55
    # routing
    keyword_bar: float = 0.80
    tree_bar: float = 0.45
    tree_min_pool: int = 20
    # guards
    min_context: float = 0.10
    min_top: float = 0.20
    min_overlap: float = 0.10
    min_words: int = 5
    max_words: int = 800
    # context and chunks
    budget: int = 300
    chunk_tokens: int = 500
    overlap_tokens: int = 50
    cache_ttl_s: int = 3600
    cache_rows: int = 500


DEFAULT = EngineConfig()
