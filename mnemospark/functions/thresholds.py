"""Defaults of every cutoff; each operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Gate:
    """Cutoffs of the admission gate."""

    min_conf: float = 0.6
    play_drop: float = 0.7
    sensitive_drop: float = 0.7
    stop_block: float = 0.58
    durable_min: float = 0.58
    importance_min: int = 3


#: (durable, importance, stop, play, sensitive, conf) of each class of text, and of a judge that can't answer.
VOTES = {
    "filler": (0.05, 1, 0.1, 0.0, 0.0, 0.9),
    "play": (0.3, 1, 0.2, 0.85, 0.0, 0.8),
    "sensitive": (0.6, 2, 0.1, 0.0, 0.9, 0.8),
    "vital": (0.9, 5, 0.05, 0.0, 0.0, 0.8),
    "routine": (0.9, 4, 0.05, 0.0, 0.0, 0.8),
    "uncertain": (0.5, 2, 0.4, 0.0, 0.0, 0.2),
}
FAIL_CLOSED = (0.5, 2, 0.5, 0.0, 0.0, 0.0)

RECALL_GATE = 0.58
RECALL_BAND = 0.45
RECALL_CAP = 8
DEDUP_JACCARD = 0.85
SCREEN_JACCARD = 0.30
SCREEN_PAIRS = 5
SHARED_TOKENS = 2
BUDGET_CHARS = 4000
CALLS_PER_WINDOW = 120
CHARS_PER_WINDOW = 200_000
WINDOW_SECONDS = 60
MEMORY_CAP = 10_000
STOP_CAP = 0.5
CONFIDENCE = (0.9, 0.05)
BLOCKED_SECONDS = 30
CONTAMINATION_SIMILARITY = 0.8
CONTAMINATION_TOKENS = 3
THRESHOLD_GRID = (0.3, 0.4, 0.5, 0.58, 0.6, 0.7, 0.8)
CONFORMAL_GRID = (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9)
CONFORMAL_COVERAGE = 0.9
COST_PER_1000_WRITES = 1000 * 475 * 4.0 / 1e6
