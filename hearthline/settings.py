"""Thresholds of the operators in one place; each value is checked when the settings are made."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Thresholds:
    dedupe_radius_m: float = 50
    dedupe_area_tolerance: float = 0.10
    dedupe_similarity: float = 0.9
    obs_per_param: int = 10
    obs_per_zone: int = 30
    min_required_coverage: float = 0.5
    optional_exclude_rate: float = 0.8
    min_confidence: float = 0.5
    folds: int = 5
    max_condition: float = 1e12
    not_modeled_share: float = 0.02
    delist_misses: int = 2
    delist_max_share_pct: float = 25
    delist_min_objects: int = 30
    hazard_min_events: int = 100
    hazard_max_deviation: float = 0.10
    hazard_horizon_days: int = 30
    hazard_holdout: float = 0.25
    schedule_epsilon: float = 0.10
    schedule_days: int = 14
    schedule_min_scans: int = 14
    backoff_minutes: float = 60
    backoff_multiplier: float = 2
    backoff_cap_minutes: float = 4320
    recovery_step: float = 1.5
    min_rate_factor: float = 0.25
    mined_occurrences: int = 5
    mined_confidence_cap: float = 0.9
    example_objects: int = 5
    shadow_percent: int = 2
    map_points: int = 500
    map_widest_degrees: float = 20
    map_zoom: int = 10
    map_color_n: int = 30

    def __post_init__(self) -> None:
        shares = {"dedupe_area_tolerance", "dedupe_similarity", "min_required_coverage", "optional_exclude_rate", "min_confidence", "not_modeled_share", "hazard_max_deviation", "hazard_holdout", "schedule_epsilon", "min_rate_factor", "mined_confidence_cap"}
        for f in fields(self):
            value = getattr(self, f.name)
            if value < 0 or f.name in shares and value > 1:
                raise ValueError(f"{f.name} = {value} is out of range")
        if self.delist_misses < 2 or self.folds < 2:
            raise ValueError("delist_misses and folds must be 2 or more")
