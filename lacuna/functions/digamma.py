"""The digamma function as SQL text that every engine reads alike."""

from __future__ import annotations


def digamma_sql(x: str) -> str:
    """Asymptotic series at x + 6, taken down by the recurrence; x is a positive number (error below 1e-9)."""
    x = f"CAST({x} AS DOUBLE)"
    y = f"({x} + 6.0)"
    down = " + ".join(f"1.0 / ({x} + {k}.0)" for k in range(6))
    series = f"ln({y}) - 0.5 / {y} - 1.0 / (12.0 * {y} * {y}) + 1.0 / (120.0 * power({y}, 4)) - 1.0 / (252.0 * power({y}, 6)) + 1.0 / (240.0 * power({y}, 8))"
    return f"({series} - ({down}))"
