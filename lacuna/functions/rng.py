"""Draws that are a pure function of a seed and a row's number, equal in every SQL engine.

Three rounds of a quadratic congruential hash modulo 2^31 - 1; every product stays below 2^63 for
ids below 1.9e14, so results do not depend on partitioning, retries or order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
#: Row ids of one dataset stay below this stride.
STRIDE = 1_000_003


def uniform_sql(seed: int, number: str) -> str:
    """SQL text of a draw in [0, 1) for a whole-number expression."""
    number = f"CAST({number} AS BIGINT)"
    one = f"((({number}) * 48271 + {seed * 69621 + 1}) % {P})"
    two = f"(({one} * {one} + ({number}) * 16807 + {seed}) % {P})"
    return f"(({two} * {two} + {one} * 16807 + {seed}) % {P} / CAST({P} AS DOUBLE))"


def uniform(seed: int, number: str) -> Column:
    return F.expr(uniform_sql(seed, number))


def normal_sql(seed: int, number: str) -> str:
    """SQL text of a standard normal draw (Box-Muller from two streams)."""
    a, b = uniform_sql(seed, number), uniform_sql(seed + 7919, number)
    return f"(sqrt(-2.0 * ln(greatest({a}, 1e-12))) * cos({2 * math.pi!r} * {b}))"


def normal(seed: int, number: str) -> Column:
    return F.expr(normal_sql(seed, number))


def row_number_sql(dataset: str = "dataset_no", row: str = "row_id") -> str:
    """The number of a row among all datasets."""
    return f"{dataset} * {STRIDE} + {row}"
