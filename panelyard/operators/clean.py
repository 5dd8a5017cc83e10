"""Causal repair of meter readings."""

from __future__ import annotations

from heapq import heappush, heappushpop

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.scale import scan_in_order

# Amplification rates of current and voltage transformers, ascending.
AMPLIFICATION_RATES = (
    5, 10, 15, 20, 25, 30, 40, 50, 60, 75, 80, 100, 120, 125, 150, 160, 200, 240, 250, 300, 315, 345, 350,
    360, 400, 480, 500, 600, 800, 1000, 1200, 1500, 2000, 2400, 3000, 4000, 5000, 10000,
)


def prior_median_step():
    """Median of a key's present values before each row, zero while there are none.

    Two heaps hold the smaller and the larger half (the smaller one negated), so a row costs the logarithm of the series.
    """
    low: list[float] = []
    high: list[float] = []

    def step(position: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        out = np.zeros(len(values))
        for i, (at, value) in enumerate(zip(position.tolist(), values.tolist())):
            if at == 1:
                low.clear()
                high.clear()
            if low:
                out[i] = -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2
            if value == value:
                if len(low) > len(high):
                    heappush(high, -heappushpop(low, -value))
                else:
                    heappush(low, -heappushpop(high, value))
        return [out]

    return step


def expanding_prior_median(df: DataFrame, value: Column, name: str = "prior_median") -> DataFrame:
    """Median of the strictly earlier readings of the same entity; zero when there are none.

    A framed exact percentile sorts the whole prefix again at every row; the ordered scan keeps both halves of it.
    """
    added = [T.StructField(name, T.DoubleType())]
    return scan_in_order(df.withColumn("_clean", value), ["entity_id"], "date", added, prior_median_step, ["_clean"]).drop("_clean")


def nearest_rate(ratio: Column) -> Column:
    """Struct (relative difference, rate) of the closest rate; the smaller rate wins a tie."""
    rates = F.array(*[F.lit(float(r)) for r in AMPLIFICATION_RATES])
    return F.array_min(F.transform(rates, lambda r: F.struct((F.abs(r - ratio) / r).alias("gap"), r.alias("rate"))))


def declip(
    df: DataFrame,
    extreme_multiple: float = 3.0,
    jump_ratio: float = 5.0,
    jump_floor: float = 100.0,
    rate_gap: float = 0.40,
) -> DataFrame:
    """Undo readings that were stored without dividing by the meter's amplification rate.

    A reading is suspect when it exceeds ``extreme_multiple`` full days of rated capacity, or jumps above
    ``jump_ratio`` times the median of the entity's earlier believable readings. A suspect reading is
    divided by the closest standard rate when the result is plausible, otherwise replaced by the prior
    median; with no prior it becomes zero. Only earlier rows of the same entity are consulted.
    """
    limit = F.col("capacity") * 24.0
    extreme = F.col("value") > extreme_multiple * limit
    work = expanding_prior_median(df, F.when(~extreme, F.col("value")))
    prior = F.col("prior_median")
    ratio = F.when(prior > 0, F.col("value") / F.greatest(prior, F.lit(1e-3)))
    suspect = extreme | ((ratio > jump_ratio) & (F.col("value") > jump_floor))
    match = nearest_rate(F.col("value") / prior)
    scaled = F.col("value") / F.col("_match.rate")
    plausible = (F.col("_match.gap") < rate_gap) & (scaled <= F.greatest(limit * 1.5, prior * 4.0))
    repaired = F.when(prior <= 0, F.lit(0.0)).when(plausible, scaled).otherwise(prior)
    return (
        work.withColumn("_suspect", F.coalesce(suspect, F.lit(False)))
        .withColumn("_match", F.when(F.col("_suspect") & (prior > 0), match))
        .withColumn("value", F.when(F.col("_suspect"), repaired).otherwise(F.col("value")))
        .select(df.columns)
    )
