"""Per-entity behaviour profiles: level shifts, irrigation season, load archetype, presence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.weather import floor_zero
from panelyard.operators.history import avg_where
from panelyard.operators.scale import latest_date

SUMMER, WINTER = (6, 7, 8), (12, 1, 2)


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded value, NULL staying NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def zero_to_one(x: Column) -> Column:
    """A zero denominator becomes one."""
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


def ratio_or(top: Column, bottom: Column, default: float) -> Column:
    """Quotient; the default when one side is missing, NULL when both are."""
    return F.when(top.isNotNull() | bottom.isNotNull(), F.coalesce(top / bottom, F.lit(default)))


def regime_shift_features(hist: DataFrame, window_days: int = 60) -> DataFrame:
    """Recent level against older level, recent volatility, rescaled summer level, trailing elevated streak."""
    v, month = F.col("value"), F.month("date")
    recent = F.col("date") >= F.date_sub(latest_date(hist), window_days)

    def positive_median(condition: Column) -> Column:
        return F.percentile(F.when(condition & (v > 0), v), F.lit(0.5))

    # The trailing streak: readings after the last one that was not elevated. Two windows by entity judge the rows where
    # they lie, so one aggregate makes everything and a panel dealt by entity is not moved.
    own = Window.partitionBy("entity_id")
    limit = 1.5 * F.coalesce(positive_median(F.lit(True)).over(own), F.lit(1.0))
    judged = hist.withColumn("_recent", recent).withColumn("_calm", F.coalesce(v <= limit, F.lit(False)))
    judged = judged.withColumn("_last_calm", F.max(F.when(F.col("_calm"), F.col("date"))).over(own))
    recent, trailing = F.col("_recent"), F.col("_last_calm").isNull() | (F.col("date") > F.col("_last_calm"))
    base = judged.groupBy("entity_id").agg(
        positive_median(recent).alias("recent_med"),
        positive_median(~recent).alias("older_med"),
        positive_median(F.lit(True)).alias("life_med"),
        avg_where(v, recent).alias("recent_mean"),
        F.stddev_samp(F.when(recent, v)).alias("recent_std"),
        F.avg(v).alias("life_mean"),
        avg_where(v, month.isin(*SUMMER)).alias("summer_mean"),
        F.sum(trailing.cast("int")).alias("_streak"),
    )
    streak = F.col("_streak")
    # An entity that never had a positive reading has no level to compare and stays NULL.
    known = F.coalesce(F.col("recent_med") / F.col("older_med"), F.col("recent_med") / F.col("life_med"), F.lit(1.0))
    ratio = F.when(F.col("life_med").isNotNull(), known)
    log_diff = F.log1p("recent_mean") - F.log1p(zero_to_one(F.col("life_mean")))
    cv = F.coalesce("recent_std", F.lit(0.0)) / zero_to_one(F.col("recent_mean"))
    scaled = F.coalesce(F.col("summer_mean") * F.col("level_shift_ratio"), zero_to_one(F.col("recent_mean")))
    return (
        base.withColumn("level_shift_ratio", clip(ratio, 0.1, 10.0))
        .select(
            "entity_id",
            "level_shift_ratio",
            clip(F.coalesce(log_diff, F.lit(0.0)), -5.0, 5.0).alias("recent_vs_lifetime_log_diff"),
            clip(cv, 0.0, 5.0).alias("recent_load_cv"),
            F.log1p(scaled).alias("scaled_summer_baseline"),
            F.least(streak, F.lit(120)).cast("int").alias("regime_persistence_days"),
        )
    )


def agro_profile(hist: DataFrame) -> DataFrame:
    """Share of summer rows and the growth from May to July and August."""
    month = F.month("date")
    out = hist.groupBy("entity_id").agg(
        F.avg(month.isin(*SUMMER).cast("double")).alias("summer_concentration_ratio"),
        avg_where(F.col("value"), month == 5).alias("_may"),
        avg_where(F.col("value"), month.isin(7, 8)).alias("_late"),
    )
    growth = ratio_or(F.col("_late"), zero_to_one(F.col("_may")), 1.0)
    return out.select(
        "entity_id",
        "summer_concentration_ratio",
        (F.col("summer_concentration_ratio") > 0.80).cast("double").alias("is_summer_exclusive"),
        clip(growth, 0.5, 5.0).alias("agro_summer_expansion_ratio"),
    )


def agro_flags(df: DataFrame, districts: Sequence[str]) -> DataFrame:
    """Irrigation district flag, its interaction with evapotranspiration, and the May start flag."""
    heavy = F.upper("district").isin(*districts).cast("double")
    return df.withColumns(
        {
            "is_heavy_agro_district": heavy,
            "agro_district_x_et0": heavy * F.col("et0_fao_evapotranspiration"),
            "is_delayed_start": (F.month("date") >= 5).cast("double") * heavy,
        }
    )


def season_cumulative(weather: DataFrame) -> DataFrame:
    """Running water deficit from May to August, restarting each year, per district and day."""
    deficit = floor_zero(F.col("et0_fao_evapotranspiration") - F.col("rain_sum"))
    season = F.when(F.month("date").between(5, 8), deficit).otherwise(F.lit(0.0))
    running = Window.partitionBy("district", F.year("date")).orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return weather.withColumn("_deficit", season).withColumn("cum_water_deficit", F.sum("_deficit").over(running)).drop("_deficit")


# Archetype codes and the order in which their rules win (first match).
ARCHETYPES = {
    "tourism": 3,
    "commercial": 4,
    "industrial": 1,
    "irrigation": 2,
    "infrastructure": 5,
    "residential": 6,
}


def archetype_rules(hist: DataFrame) -> DataFrame:
    """Sunday, summer and volatility ratios and the behaviour class they imply."""
    v, month, dow = F.col("value"), F.month("date"), F.weekday("date")
    agg = hist.groupBy("entity_id").agg(
        avg_where(v, dow == 6).alias("sunday"),
        avg_where(v, dow < 5).alias("weekday"),
        avg_where(v, month.isin(*SUMMER)).alias("summer"),
        avg_where(v, month.isin(*WINTER)).alias("winter"),
        F.stddev_samp(v).alias("std"),
        F.avg(v).alias("mean"),
    )

    def ratio(top: str, bottom: str, low: float, high: float, default: float = 1.0) -> Column:
        return clip(ratio_or(F.col(top), zero_to_one(F.col(bottom)), default), low, high)

    out = agg.select(
        "entity_id",
        ratio("sunday", "weekday", 0.1, 3.0).alias("sunday_to_weekday_ratio"),
        ratio("summer", "winter", 0.1, 10.0).alias("summer_to_winter_ratio"),
        ratio("std", "mean", 0.0, 5.0, default=0.0).alias("load_volatility_cv"),
    )
    sunday, season, cv = F.col("sunday_to_weekday_ratio"), F.col("summer_to_winter_ratio"), F.col("load_volatility_cv")
    rules = {
        "tourism": (sunday > 1.15) & (season > 1.8),
        "commercial": sunday < 0.40,
        "industrial": sunday < 0.60,
        "irrigation": season > 3.0,
        "infrastructure": cv < 0.20,
        "residential": F.lit(True),
    }
    code = F.lit(None).cast("double")
    for name in reversed(ARCHETYPES):
        code = F.when(rules[name], F.lit(float(ARCHETYPES[name]))).otherwise(code)
    return out.withColumn("archetype_code", code)


def presence_features(df: DataFrame, edge_days: int = 14) -> DataFrame:
    """Shape of each entity's row calendar inside the span of ``df``; no reading is consulted.

    The spans come from one small aggregate that is joined back, so the rows themselves are not sorted.
    """
    span = df.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    edges = span.select(F.struct("start", "end")).scalar()
    per = df.groupBy("entity_id").agg(
        F.count("*").cast("double").alias("days"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    per = per.withColumn("_w", edges)
    width = F.greatest(F.datediff("_w.end", "_w.start") + 1, F.lit(1)).cast("double")
    lag, lead = F.datediff("first", "_w.start"), F.datediff("_w.end", "last")
    live = F.greatest(F.datediff("last", "first") + 1, F.lit(1))
    shape = per.select(
        "entity_id",
        (F.col("days") / width).alias("pres_frac"),
        (lag / width).alias("pres_start_lag"),
        (lead / width).alias("pres_end_lead"),
        (lead > edge_days).cast("int").alias("pres_ends_early"),
        (lag > edge_days).cast("int").alias("pres_starts_late"),
        F.greatest(1.0 - F.col("days") / live, F.lit(0.0)).alias("pres_gap_frac"),
    )
    return df.join(shape, "entity_id", "left")
