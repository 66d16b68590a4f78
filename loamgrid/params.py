"""Thresholds of the pipeline in one frozen place; nothing reads the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    chunk_size: int = 800
    chunk_overlap: int = 120
    min_text_piece: int = 50
    min_table_piece: int = 30
    table_lines: int = 14
    tail_over: int = 20
    vector_topk: int = 20
    bm25_topk: int = 20
    final_topk: int = 8
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75


DEFAULTS = Params()
