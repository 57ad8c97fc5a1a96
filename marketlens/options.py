"""Options of the analytics, with the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND

#: The five standard windows: label and microseconds.
WINDOWS = {"5m": 5 * MINUTE, "15m": 15 * MINUTE, "1h": HOUR, "4h": 4 * HOUR, "24h": DAY}


@dataclass(frozen=True)
class AnalyticsOptions:
    """max_age: how old the newest row of a venue may be at an instant. sum_scale: digits after the point in which sums
    are exact decimals (None: plain double sums)."""

    max_age: int = 10 * MINUTE
    windows: dict[str, int] = field(default_factory=lambda: dict(WINDOWS))
    liquidation_lookback: int = 5 * MINUTE
    sum_scale: int | None = None


@dataclass(frozen=True)
class ValidationOptions:
    """future_skew: how far in the future a row's time may lie. funding_limit: largest plausible absolute rate."""

    future_skew: int = 120 * SECOND
    funding_limit: float = 0.05


@dataclass(frozen=True)
class FlagThresholds:
    liquidation_usd: float = 1_000_000.0
    basis_percent: float = 1.0
    funding_rate: float = 0.001
    imbalance_percent: float = 50.0


@dataclass(frozen=True)
class ListOptions:
    """Filters, order and page of a list. A filter of None is not applied."""

    symbol_id: int | None = None
    exchange: str | None = None
    period: str | None = None
    start: str | None = None
    end: str | None = None
    descending: bool = True
    limit: int = 50
    offset: int = 0
