"""Every threshold of the analytics in one place; nothing below reads a clock or a machine's zone."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Settings:
    # fixed values: the definitions of the measures depend on them
    qualifying_ms: int = 30_000
    skip_ms: int = 20_000
    skip_reasons: tuple[str, ...] = ("fwdbtn", "backbtn")
    session_gap_minutes: int = 30
    include_private: bool = False
    dormancy_days: int = 365
    recent_days: int = 180
    obsession_window_days: int = 30
    obsession_least_window_plays: int = 5
    obsession_least_plays: dict = field(default_factory=lambda: {"track": 20, "artist": 60, "album": 30})
    lost_least_plays: int = 8
    lost_least_ms: int = 20 * 60_000
    lost_most_recent_share: float = 0.05
    lost_least_score: float = 30.0
    lost_weights: tuple[float, ...] = (0.30, 0.26, 0.17, 0.13, 0.14)
    diversity_cap: int = 2
    graveyard_least_plays: dict = field(default_factory=lambda: {"track": 25, "artist": 60, "album": 30})
    graveyard_days: int = 730
    graveyard_most_recent: int = 2
    era_window_months: int = 3
    era_least_months: int = 3
    era_change: float = 0.42
    era_strong_change: float = 0.68
    era_merge: float = 0.78
    era_least_month_plays: int = 10
    era_least_active_months: int = 6
    era_vector_size: int = 40
    comeback_gap_days: int = 180
    comeback_least_plays: int = 5
    comeback_window_days: int = 90
    milestones: tuple[int, ...] = (10, 25, 50, 100, 250, 500, 1000)
    # (name, first hour, hour after the last)
    dayparts: tuple = (("lateNight", 0, 5), ("morning", 5, 12), ("afternoon", 12, 17), ("evening", 17, 22), ("night", 22, 24))
    most_ms: int = 86_400_000
    page_cap: int = 500


DEFAULTS = Settings()
#: Clocks of the catalogue's queries, chosen where the gates separate the test rows.
LOST_NOW = 1_028_160_000_000  # 2002-08-01
GRAVEYARD_NOW = 1_067_904_000_000  # 2003-11-04
