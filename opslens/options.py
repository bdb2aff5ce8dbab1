"""Options of the operators: defaults and the least values that make sense."""

from __future__ import annotations

from dataclasses import dataclass

# Least accepted value per option. No option has a greatest one.
LEAST: dict[str, float] = {
    "exception_scan_lines": 1,
    "repeat_scan_lines": 1,
    "throughput_scan_lines": 1,
    "grep_limit_per_file": 1,
    "grep_limit_total": 1,
    "key_length": 1,
    "n1_threshold": 1,
    "slow_sql_ms": 0.0,
    "samples_per_request": 1,
    "report_interval_s": 1,
    "retention_hours": 1,
    "max_table_mb": 1,
    "table_tail_limit": 1,
    "exception_groups": 1,
    "repeat_groups": 1,
    "throughput_minutes": 1,
}


@dataclass(frozen=True)
class Options:
    """A limit of None means no limit."""

    exception_scan_lines: int | None = 10_000
    repeat_scan_lines: int | None = 10_000
    throughput_scan_lines: int | None = 5_000
    grep_limit_per_file: int | None = 500
    grep_limit_total: int | None = 2_000
    min_level: str = "WARNING"
    flush_ms: int = 2_000
    grouping: bool = True
    key_length: int = 30
    n1_threshold: int = 5
    slow_sql_ms: float = 10.0
    samples_per_request: int | None = 500
    tracked_statuses: tuple[int, ...] = (200,)
    track_cli: bool = True
    track_mq: bool = True
    slow_endpoint_ms: float = 0.0
    report_interval_s: int = 60
    snapshot_ttl_s: int = 1_800
    retention_hours: int = 24
    max_table_mb: int = 500
    channels: tuple[str, ...] = ()
    table_tail_limit: int | None = 50
    spike_lines: int | None = 500
    spike_threshold: int = 20
    exception_groups: int | None = 50
    repeat_groups: int | None = 200
    throughput_minutes: int | None = 60

    def __post_init__(self) -> None:
        for name, low in LEAST.items():
            value = getattr(self, name)
            if value is not None and value < low:
                raise ValueError(f"{name} must be at least {low}, not {value}")

    @classmethod
    def statuses_from_text(cls, text: str | None) -> tuple[int, ...]:
        """``"200, 404"`` -> ``(200, 404)``; blank means every status is tracked."""
        parts = (part.strip() for part in (text or "").split(","))
        return tuple(int(part) for part in parts if part.isdigit())


DEFAULTS = Options()
