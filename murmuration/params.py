"""Defaults of segmentation, topics and ranking."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    weak_gap_ms: int = 300_000
    strong_gap_ms: int = 1_800_000
    same_sender_ms: int = 60_000
    burst_max: int = 20
    topic_ttl_ms: int = 21_600_000
    beta: float = 0.3
    gamma: float = 0.1
    all_candidates_max: int = 40
    candidate_k: int = 5
    tau_low: float = 0.25
    tau_high: float = 0.6
