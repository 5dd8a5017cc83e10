"""Cohorts, id prefixes and their fallbacks for entities without history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.capacity import bucket_by_edges
from panelyard.operators.history import avg_where, safe_slope
from panelyard.operators.scale import attach, catalogue_quantiles, measured, with_totals

COHORT_STATS = (
    "coh_mean", "coh_cv", "coh_n", "coh_lf", "coh_cdd_slope", "coh_cddlog_slope", "coh_hdd_slope",
    "coh_dow_amp", "coh_wknd_lf", "coh_moy_dev",
)


def capacity_edges(hist: DataFrame, buckets: int = 8) -> DataFrame:
    """One row: the sorted distinct interior quantiles of log capacity over history rows."""
    probs = {f"q{i}": i / buckets for i in range(1, buckets)}
    edges = catalogue_quantiles(hist.select(F.log1p("capacity").alias("_log_cap")), "_log_cap", probs)
    return edges.select(F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def with_capacity_bucket(df: DataFrame, edges: DataFrame, name: str = "cap_bucket") -> DataFrame:
    """Number of quantile edges at or below the row's log capacity."""
    return with_totals(df, edges).withColumn(name, bucket_by_edges(F.log1p("capacity"), F.col("edges"))).drop("edges")


def cohort_stats(hist: DataFrame, edges: DataFrame, keys: Sequence[str] = ("district", "cap_bucket")) -> DataFrame:
    """Behaviour of each cohort: level, spread, load factor, weather slopes, weekend amplitude."""
    y = F.col("log_value")
    lf = F.try_divide(F.col("value"), F.col("capacity") * 24.0)
    weekend = F.weekday("date") >= 5
    rows = with_capacity_bucket(hist, edges)
    return rows.groupBy(*keys).agg(
        F.avg(y).alias("coh_mean"),
        F.stddev_samp(y).alias("coh_cv"),
        F.count("*").cast("double").alias("coh_n"),
        F.avg(lf).alias("coh_lf"),
        safe_slope(y, F.col("cdd22")).alias("coh_cdd_slope"),
        safe_slope(y, F.col("cdd_log")).alias("coh_cddlog_slope"),
        safe_slope(y, F.col("hdd18")).alias("coh_hdd_slope"),
        (avg_where(y, weekend) - avg_where(y, ~weekend)).alias("coh_dow_amp"),
        avg_where(lf, weekend).alias("coh_wknd_lf"),
    )


def cohort_month_shape(hist: DataFrame, edges: DataFrame, keys: Sequence[str] = ("district", "cap_bucket")) -> DataFrame:
    """Month-of-year deviation from the cohort mean, so it carries shape and not level."""
    rows = with_capacity_bucket(hist, edges)
    months = rows.groupBy(*keys, F.month("date").alias("month")).agg(F.sum("log_value").alias("s"), F.count("log_value").alias("n"))
    means = months.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("_mean"))
    return months.join(means, list(keys)).select(
        *keys, "month", (F.col("s") / F.col("n") - F.col("_mean")).alias("coh_moy_dev")
    )


def attach_cohort(rows: DataFrame, hist: DataFrame, keys: Sequence[str] = ("district", "cap_bucket")) -> DataFrame:
    """Cohort statistics on every row; an unknown cohort gets the mean of the attached column."""
    edges = capacity_edges(hist)
    out = with_capacity_bucket(rows, edges).withColumn("month", F.month("date"))
    out = attach(out, cohort_stats(hist, edges, keys), keys)
    out = attach(out, cohort_month_shape(hist, edges, keys), [*keys, "month"])
    means = out.agg(*[F.avg(c).alias(f"_{c}") for c in COHORT_STATS])
    filled = with_totals(out, means)
    return filled.withColumns({c: F.coalesce(c, f"_{c}") for c in COHORT_STATS}).drop(*[f"_{c}" for c in COHORT_STATS])


# Identifier prefix lengths and the pseudo-counts of their shrinkage.
PREFIX_LENGTHS = (3, 5)
K_DEAD, K_LEVEL = 5.0, 10.0


def shrink(mean: Column, n: Column, prior: Column, k: float) -> Column:
    """Weighted mean of an estimate and its prior, the prior counting as ``k`` observations."""
    return (mean * n + prior * k) / (n + k)


def entity_life(hist: DataFrame) -> DataFrame:
    """Per entity: whether every reading was zero, and its mean level."""
    return hist.groupBy("entity_id").agg(
        F.min((F.col("value") == 0).cast("double")).alias("dead"), F.avg("log_value").alias("level")
    )


def prefix_rates(hist: DataFrame, lengths: Sequence[int] = PREFIX_LENGTHS) -> DataFrame:
    """Dead rate and level per identifier prefix, shrunk to the fleet: columns length, prefix, dead, level, n."""
    return life_rates(measured(entity_life(hist)), lengths)


def life_rates(per: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """The same from a stored ``entity_life``, so the readings are passed over once."""
    fleet = per.agg(F.avg("dead").alias("fleet_dead"), F.avg("level").alias("fleet_level"))
    prefixes = F.explode(
        F.array(*[F.struct(F.lit(k).alias("length"), F.substring("entity_id", 1, k).alias("prefix")) for k in lengths])
    )
    groups = (
        per.select(prefixes.alias("p"), "dead", "level")
        .groupBy("p.length", "p.prefix")
        .agg(F.avg("dead").alias("d"), F.avg("level").alias("l"), F.count("*").alias("size"))
    )
    return with_totals(groups, fleet).select(
        "length",
        "prefix",
        shrink(F.col("d"), F.col("size"), F.col("fleet_dead"), K_DEAD).alias("dead"),
        shrink(F.col("l"), F.col("size"), F.col("fleet_level"), K_LEVEL).alias("level"),
        F.log1p("size").alias("n"),
        "fleet_dead",
        "fleet_level",
    )


def attach_prefix(rows: DataFrame, hist: DataFrame, lengths: Sequence[int] = PREFIX_LENGTHS) -> DataFrame:
    """Prefix columns on every row; an unknown prefix gets the fleet values and a zero count."""
    life = measured(entity_life(hist))
    rates = measured(life_rates(life, lengths))
    fleet = life.agg(F.avg("dead").alias("_fd"), F.avg("level").alias("_fl"))
    out = with_totals(rows, fleet)
    for k in lengths:
        one = rates.where(F.col("length") == k).select(
            F.col("prefix").alias("_prefix"),
            F.col("dead").alias(f"pfx{k}_dead"),
            F.col("level").alias(f"pfx{k}_mean"),
            F.col("n").alias(f"pfx{k}_n"),
        )
        out = out.withColumn("_prefix", F.substring("entity_id", 1, k)).join(one, "_prefix", "left").drop("_prefix")
        out = out.withColumns(
            {
                f"pfx{k}_dead": F.coalesce(f"pfx{k}_dead", "_fd"),
                f"pfx{k}_mean": F.coalesce(f"pfx{k}_mean", "_fl"),
                f"pfx{k}_n": F.coalesce(F.col(f"pfx{k}_n"), F.lit(0.0)),
            }
        )
    return out.drop("_fd", "_fl")
