"""Run parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values of the price model; override per call with ``replace``."""

    # Market statistics
    window_days: int = 45
    sold_hours: int = 48
    sold_weight: float = 2.0
    min_samples: int = 8
    tier_high: int = 15
    tier_medium: int = 8
    tier_low: int = 4

    # Deals and alerts
    deal_percentile: float = 0.20
    alert_min_score: float = 45.0
    alert_batch: int = 10
    retail_days: int = 7

    # Ingestion
    cycle_minutes: int = 45

    # Classification
    fuzzy_cutoff: int = 88
    adjust_limit_pct: float = 35.0
    description_chars: int | None = 8000  # of an ad's description; None keeps all

    # Rule dry runs, where a caller wants the newest titles only
    preview_scan: int = 4000
    preview_examples: int = 10

    # Width of the time slots a listing's history is ordered in.
    slot_minutes: int = 60

    def __post_init__(self) -> None:
        if self.sold_weight <= 0:
            raise ValueError("sold_weight must be positive")

    @property
    def grace_hours(self) -> int:
        """Hours without a sighting before a listing counts as gone."""
        return max(6, self.cycle_minutes * 4 // 60)
