"""Job parameters. Thresholds and limits are data: every rule takes them from here."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime


@dataclass(frozen=True)
class Params:
    as_of: datetime = datetime(2024, 1, 29, 14, tzinfo=UTC)
    since: datetime | None = None
    until: datetime | None = None
    salt: str = "fixture-salt"
    session_limit: int = 8
    project_limit: int = 8
    tool_limit: int = 20
    driver_limit: int = 5
    trend_days: int = 7
    projection_days: int = 30
    pricing_version: int = 2
    # thresholds of the findings, fixed values
    model_share: float = 0.5
    output_share: float = 0.15
    cache_1h_usd: float = 10.0
    cache_1h_share: float = 0.5
    cache_write_share: float = 0.35
    cache_read_share: float = 0.8
    context_tokens: int = 150_000
    context_usd: float = 5.0
    context_high_share: float = 0.2
    session_usd: float = 10.0
    mcp_usd: float = 10.0
    mcp_high_share: float = 0.2
    bash_usd: float = 25.0
    acceleration_pct: float = 0.5
    acceleration_usd: float = 10.0
    anomaly_ratio: float = 2.0

    def __post_init__(self):
        if not 1 <= self.trend_days <= 90:
            raise ValueError("trend_days must be from 1 to 90")
        if not 1 <= self.session_limit <= 10_000:
            raise ValueError("session_limit must be from 1 to 10000")
        if self.since and self.until and self.since >= self.until:
            raise ValueError("since must come before until")

    def but(self, **changes) -> Params:
        return replace(self, **changes)
