"""Level priors for entities without history: shrunken, monotone in capacity, with fallbacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.groups import shrink
from panelyard.operators.profiles import clip
from panelyard.operators.scale import exact_quantiles, measured, null_safe, with_totals


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least-squares fit: merge neighbours while they fall, then spread the means."""
    blocks: list[tuple[float, float, int]] = []
    for value, weight in zip(values, weights):
        mean, mass, size = float(value), float(weight), 1
        while blocks and blocks[-1][0] >= mean:
            other, other_mass, other_size = blocks.pop()
            mean = (mean * mass + other * other_mass) / (mass + other_mass)
            mass, size = mass + other_mass, size + other_size
        blocks.append((mean, mass, size))
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def isotonic_by_group(cells: DataFrame, group: str, order: str, value: str, weight: str, name: str = "fitted") -> DataFrame:
    """Weighted non-decreasing fit of ``value`` along ``order`` inside each group.

    ``cells`` holds one row per distinct ``order`` step of a group (capacity ratings, a catalogue of sizes),
    already reduced from the panel by a map-side combined aggregate. The fit is linear in the cells.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        frame[name] = pool_adjacent(frame[value].to_numpy(float), frame[weight].to_numpy(float))
        return frame

    schema = T.StructType([*cells.schema.fields, T.StructField(name, T.DoubleType())])
    return cells.groupBy(group).applyInPandas(fit, schema)


def shrunk_cells(hist: DataFrame, k: float, level: str = "log_value") -> DataFrame:
    """Mean level per (region, capacity), shrunk to the region mean; region mean and cell count kept."""
    cells = hist.groupBy("region", "capacity").agg(F.sum(level).alias("_s"), F.count(level).alias("n"))
    regions = cells.groupBy("region").agg((F.sum("_s") / F.sum("n")).alias("region_mean"))
    return cells.join(regions, "region").select(
        "region",
        "capacity",
        "n",
        "region_mean",
        shrink(F.col("_s") / F.col("n"), F.col("n"), F.col("region_mean"), k).alias("shrunk"),
    )


def monotone_cells(cells: DataFrame, cap: float | None = None, min_cells: int = 3) -> DataFrame:
    """Replace each shrunken cell by its monotone fit, where a region has enough cells."""
    count = F.count("*").over(Window.partitionBy("region"))
    fitted = isotonic_by_group(cells, "region", "capacity", "shrunk", "n").withColumn("_cells", count)
    move: Column = F.col("fitted") - F.col("shrunk")
    if cap is not None:
        move = clip(move, -cap, cap)
    prior = F.when(F.col("_cells") >= min_cells, F.col("shrunk") + move).otherwise(F.col("shrunk"))
    return fitted.withColumn("prior", prior).select("region", "capacity", "n", "region_mean", "shrunk", "prior")


def cold_prior(hist: DataFrame, k: float = 5.0, cap: float = 1.0, monotone: bool = True) -> DataFrame:
    """Cells with columns region, capacity, n, region_mean, shrunk, prior."""
    cells = shrunk_cells(hist, k)
    if not monotone:
        return cells.withColumn("prior", F.col("shrunk"))
    return monotone_cells(cells, cap)


def winsorized(hist: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """History with levels clipped to the exact quantiles of their (region, capacity) cell."""
    keys = ["region", "capacity"]
    limits = measured(exact_quantiles(hist, keys, "log_value", {"_lo": low, "_hi": high}))
    joined = hist.join(limits, null_safe(hist, limits, keys), "left").select(hist["*"], "_lo", "_hi")
    clipped = F.when(F.col("log_value").isNotNull(), F.greatest("_lo", F.least("_hi", "log_value")))
    return joined.withColumn("log_value", clipped).drop("_lo", "_hi")


def cold_prior_winsor(hist: DataFrame, k: float = 5.0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """As ``cold_prior`` on winsorised levels and without a cap on the monotone correction."""
    return monotone_cells(shrunk_cells(winsorized(hist, low, high), k))


def attach_prior(rows: DataFrame, cells: DataFrame, hist_mean: DataFrame) -> DataFrame:
    """Add ``prior`` by cell, then region, then the fleet mean (a one-row table with column fleet_mean)."""
    cells = measured(cells)
    regions = cells.groupBy("region").agg(F.first("region_mean").alias("_region_mean"))
    out = rows.join(cells.select("region", "capacity", F.col("prior").alias("_cell")), ["region", "capacity"], "left")
    out = with_totals(out.join(regions, "region", "left"), hist_mean)
    return out.withColumn("prior", F.coalesce("_cell", "_region_mean", "fleet_mean")).drop(
        "_cell", "_region_mean", "fleet_mean"
    )


def fleet_mean(hist: DataFrame) -> DataFrame:
    return hist.agg(F.avg("log_value").alias("fleet_mean"))


def blend_cold(prediction: Column, prior: Column, seen: Column, alpha: float = 0.8) -> Column:
    """Blend in log space on unseen rows only."""
    return F.when(seen, prediction).otherwise((1.0 - alpha) * prediction + alpha * prior)
