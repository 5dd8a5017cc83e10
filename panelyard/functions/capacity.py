"""Rated-capacity columns and forecast transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard.functions.weather import floor_zero

# Right-closed capacity class edges in kVA.
CAPACITY_EDGES = (0, 100, 250, 400, 630, 1000, 1600, 1_000_000_000)


def capacity_bucket_fixed(capacity: Column, edges: Sequence[float] = CAPACITY_EDGES) -> Column:
    """0-based index of the right-closed interval holding ``capacity``; NULL outside."""
    bucket = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        bucket = F.when((capacity > edges[i]) & (capacity <= edges[i + 1]), F.lit(i)).otherwise(bucket)
    return bucket


def bucket_by_edges(x: Column, edges: Column) -> Column:
    """How many of the sorted ``edges`` are at or below ``x``."""
    return F.size(F.filter(edges, lambda e: e <= x))


def daily_limit(capacity: Column) -> Column:
    """Energy a unit at full rated capacity moves in a day; capacities below one count as one."""
    return F.greatest(capacity.cast("double"), F.lit(1.0)) * 24.0


def load_factor(value: Column, capacity: Column) -> Column:
    return value / daily_limit(capacity)


def forecast_invert(log_prediction: Column) -> Column:
    """Back from log space, never negative; a missing prediction stays missing."""
    return floor_zero(F.expm1(log_prediction))


def hurdle_dampen(log_prediction: Column, p_active: Column, seen: Column, threshold: float = 0.90) -> Column:
    """On seen rows, scale the linear forecast by the root of a low activity probability."""
    factor = F.when(seen & (p_active < threshold), F.sqrt(p_active)).otherwise(F.lit(1.0))
    return F.log1p(F.expm1(log_prediction) * factor)
