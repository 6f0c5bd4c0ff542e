"""Defaults of the rule gate, the ranker and the bandit; a user's settings go over them key by key."""

from __future__ import annotations

from collections.abc import Mapping

#: Fixed values that the rules share (thresholds, bin edges, learning constants).
DEFAULTS: dict[str, float] = {
    "mae_art_max": 8.0,
    "mae_art_borderline": 1.0,
    "silhouette_iou_min": 0.85,
    "glow_area_pct_max": 8.0,
    "color_cap": 8,
    "speckle_max": 40,
    "luma_delta_min": 12,
    "node_max": 500,
    "weak_needed": 3,
    "bucket_cap": 3,
    "learn_min_rejections": 3,
}
SPECKLE_EDGES = (0, 5, 20, 40)
COLOUR_EDGES = (1, 3, 5, 8)
TTL_SECONDS = 30 * 24 * 3600.0
EPSILON = 0.1
FIT = {"iterations": 300, "rate": 0.5, "l2": 0.01}
COLD_START_PICKS, COLD_START_JOBS = 30, 2
HOLDOUT_FRACTION = 0.2
INTENT_THRESHOLD = 0.8


def settings(user: Mapping | None = None) -> dict[str, float]:
    """Defaults with the user's numbers over them; other kinds of values (a boolean is no number) are passed over."""
    merged = dict(DEFAULTS)
    for key, value in (user or {}).items():
        if isinstance(value, int | float) and not isinstance(value, bool):
            merged[key] = value
    return merged
