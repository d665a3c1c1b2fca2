"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Default channel order, rule models and state names.
CHANNELS = ("google", "meta", "tiktok", "email", "referral")
RULE_MODELS = ("first_touch", "last_touch", "linear", "time_decay", "position_based")
DATA_DRIVEN_MODELS = ("markov", "shapley")
START, CONVERSION, NULL_STATE = "(start)", "(conversion)", "(null)"
PATH_SEPARATOR = " > "
DAYS_PER_MONTH = 30.0


@dataclass(frozen=True)
class AttributionConfig:
    """Parameters of the attribution jobs.

    ``lookback_mode`` is ``fractional`` (age in days, with fractions) or
    ``calendar`` (midnights crossed).

    Users with more than ``hot_user_rows`` touches are cut into time slices so
    that no single task orders them. ``None`` skips the detection, for logs
    known to be even.
    """

    channels: tuple[str, ...] = CHANNELS
    lookback_days: float = 45.0
    lookback_mode: str = "fractional"
    half_life_days: float = 7.0
    position_first: float = 0.40
    position_middle: float = 0.20
    position_last: float = 0.40
    hot_user_rows: int | None = 5_000_000

    def __post_init__(self) -> None:
        if self.lookback_mode not in ("fractional", "calendar"):
            raise ValueError(f"unknown lookback_mode {self.lookback_mode!r}")
        if self.lookback_days < 0:
            raise ValueError("lookback_days must not be negative")
        if self.half_life_days <= 0:
            raise ValueError("half_life_days must be positive")
        if not self.channels or len(set(self.channels)) != len(self.channels):
            raise ValueError("channels must be a non-empty list of distinct names")
