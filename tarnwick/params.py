"""Retrieval knobs, with their published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The defaults of the retrieval operators.
    file_fusion_w: float = 0.5
    test_penalty: float = 0.85
    file_boost: float = 0.05
    sym_boost: float = 0.03
    boost_cap: int = 2
    issue_threshold: int = 25
    rrf_k: int = 60
    tier_bonus: tuple[float, float, float] = (0.6, 0.25, 0.10)
    span_bonus: float = 0.15
    tier1_max: int = 4
    tier1_gap: float = 0.97
    cand_files: int = 12
    graph_extras: int = 7
    extras_from: int = 3
    chunk_keep: float = 0.8
    chunk_cap: int = 12
    multi_extra: int = 2
    recall_floor: int = 15
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    semantic_top: int = 3
    semantic_min: float = 0.80
    surprise_min: float = 0.85
    flow_attach: float = 0.62
    flow_serve: float = 0.88
    flow_cover: float = 0.8
    flow_same: float = 0.92
    chunk_budget: int = 4000
    max_file_bytes: int = 600_000


DEFAULTS = Params()
