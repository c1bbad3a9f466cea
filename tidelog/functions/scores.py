"""Arithmetic of the golden signals and the anomaly score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Saturation weights and reference concurrency; robust-z constants.
REFERENCE_IN_FLIGHT = 8
MAD_TO_SIGMA = 0.6745
MAD_FLOOR = 1e-6
FLAT_SCORE = 10.0


def saturation(traffic: Column, p50: Column, p95: Column, error_rate: Column) -> Column:
    """0–100 from occupancy, error pressure and tail inflation."""
    hundred = F.lit(100.0)
    occupancy = F.least(hundred, traffic * (p95 / 1000) / REFERENCE_IN_FLIGHT * 100)
    errors = F.least(hundred, error_rate * 5)
    inflation = F.when(p50 > 0, F.try_divide(p95, p50)).otherwise(F.lit(1.0))
    tail = F.least(hundred, F.greatest(F.lit(0.0), (inflation - 1) / 3 * 100))
    return F.least(hundred, 0.5 * occupancy + 0.3 * errors + 0.2 * tail)


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """Median / MAD score; on a flat baseline a jump scores 10 and anything else 0."""
    jump = x > F.greatest(median * 5, median + 50)
    return F.when(mad < MAD_FLOOR, F.when(jump, FLAT_SCORE).otherwise(0.0)).otherwise(
        F.try_divide(MAD_TO_SIGMA * (x - median), mad)
    )
