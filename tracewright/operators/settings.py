"""Thresholds of every rule, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # segmentation
    score_floor: float = 0.08
    score_sigmas: float = 2.0
    least_segment_ms: int = 700
    sample_ms: int = 200
    nav_change: float = 0.55
    dialog_change: float = 0.12
    ambient_low: float = 0.6
    ambient_high: float = 1.6
    ambient_samples: int = 30
    ambient_spread: float = 0.7
    nav_rate: float = 24.0
    dialog_rate: float = 8.0
    keyframe_after_ms: int = 350
    keyframe_long_ms: int = 4000
    keyframe_before_end_ms: int = 500
    # events
    scroll_px: float = 3.0
    scroll_gap_ms: int = 600
    scroll_before_ms: int = 500
    scroll_after_ms: int = 250
    click_before_ms: int = 1200
    click_after_ms: int = 150
    click_dedupe_ms: int = 800
    label_ms: int = 3000
    label_px: float = 150.0
    # anomalies
    blank_lum: float = 8.0
    blank_gap_ms: int = 2000
    stall_score: float = 0.01
    stall_ms: int = 8000
    # steps
    after_bug_ms: int = 1500
    effect_ms: int = 2000
    boundary_ms: int = 400
    scroll_merge_ms: int = 2500
    run_gap_ms: int = 3000
    chronology_ms: int = 1500
