"""Leak-free aggregates of pre-cutoff history.

Every function takes history that was already filtered to ``date < cutoff``; nothing here looks further.
Entity aggregates are bounded by the calendar. Group aggregates (district, capacity, ...) use only
mergeable functions, so a district holding a third of all rows is reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.capacity import capacity_bucket_fixed, load_factor
from panelyard.operators.scale import exact_quantiles, latest_date


def before_cutoff(df: DataFrame, cutoff: str) -> DataFrame:
    return df.where(F.col("date") < F.to_date(F.lit(cutoff)))


def target_window(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where((F.col("date") >= F.to_date(F.lit(start))) & (F.col("date") < F.to_date(F.lit(end))))


def recent_window(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` days, counted back from the latest date of the whole table."""
    return df.where(F.col("date") > F.date_sub(latest_date(df), days))


def safe_slope(y: Column, x: Column, where: Column | None = None) -> Column:
    """OLS slope of y on x over rows where both are present; NULL when x does not vary."""
    both = x.isNotNull() & y.isNotNull()
    keep = both if where is None else both & where
    yy, xx = F.when(keep, y), F.when(keep, x)
    flat = F.max(xx) == F.min(xx)
    return F.when(~flat, F.regr_slope(yy, xx))


def group_slope(df: DataFrame, keys: Sequence[str], x: str, y: str = "log_value", name: str = "slope") -> DataFrame:
    return df.groupBy(*keys).agg(safe_slope(F.col(y), F.col(x)).alias(name))


def avg_where(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))


def entity_history(hist: DataFrame) -> DataFrame:
    """One row per entity: level, spread, quantiles, recent levels, trends, heat response, load factor.

    A single hash aggregate; the recent windows are conditional sums over the same pass.
    """
    y = F.col("log_value")
    zero = 1.0 - F.col("is_pos")
    last = latest_date(hist)
    age = F.datediff(last, F.col("date"))

    probs = {"ent_p10": 0.10, "ent_p25": 0.25, "ent_median": 0.5, "ent_p75": 0.75, "ent_p90": 0.90}
    aggs = {
        # One buffer of the entity's daily values serves all five quantiles.
        "_quantiles": F.percentile(y, F.array(*[F.lit(p) for p in probs.values()])),
        "ent_mean": F.avg(y),
        "ent_std": F.stddev_samp(y),
        "ent_min": F.min(y),
        "ent_max": F.max(y),
        "ent_zero": F.avg(zero),
        "ent_cnt": F.count("*").cast("double"),
        "ent_lf": F.avg(load_factor(F.col("value"), F.col("capacity"))),
    }
    for w in (7, 28, 91):
        aggs[f"ent_r{w}_mean"] = avg_where(y, age < w)
        aggs[f"ent_r{w}_zero"] = avg_where(zero, age < w)
        if w > 7:
            aggs[f"ent_r{w}_std"] = F.stddev_samp(F.when(age < w, y))
    aggs["ent_slope90"] = safe_slope(y, (F.lit(90) - age).cast("double"), age < 90)
    if "cdd22" in hist.columns:
        aggs["ent_cdd_slope"] = safe_slope(y, F.col("cdd22"))
        aggs["ent_summer_mean"] = avg_where(y, F.col("cdd22") > 0)
    if "cdd_log" in hist.columns:
        aggs["ent_cddlog_slope"] = safe_slope(y, F.col("cdd_log"))
    if "temperature_2m_mean" in hist.columns:
        aggs["_hot_mean"] = avg_where(y, F.col("temperature_2m_mean") > 25.0)
    out = hist.groupBy("entity_id").agg(*[c.alias(n) for n, c in aggs.items()])
    out = out.withColumns({n: F.get("_quantiles", F.lit(i)) for i, n in enumerate(probs)})
    absent = F.lit(None).cast("double")
    for name in ("ent_cdd_slope", "ent_summer_mean", "ent_cddlog_slope", "_hot_mean"):
        if name not in aggs:
            out = out.withColumn(name, absent)
    return out.withColumns(
        {
            "ent_iqr": F.col("ent_p75") - F.col("ent_p25"),
            "ent_trend": F.col("ent_r28_mean") - F.col("ent_r91_mean"),
            "ent_zero_trend": F.col("ent_r28_zero") - F.col("ent_zero"),
            "ent_summer_delta": F.col("ent_summer_mean") - F.col("ent_mean"),
            "ent_hot_delta": F.col("_hot_mean") - F.col("ent_mean"),
        }
    ).drop("_hot_mean", "_quantiles")


def entity_profiles(hist: DataFrame) -> DataFrame:
    """Entity x month and entity x weekday means in one pass: columns entity_id, month, dow, level.

    Exactly one of month and dow is set per row.
    """
    # Collapse to entity x month x weekday first: at most 84 rows per entity reach the second step.
    cells = hist.groupBy("entity_id", F.month("date").alias("month"), F.weekday("date").alias("dow")).agg(
        F.sum("log_value").alias("s"), F.count("log_value").alias("n")
    )
    axes = F.array(
        F.struct(F.col("month"), F.lit(None).cast("int").alias("dow")),
        F.struct(F.lit(None).cast("int").alias("month"), F.col("dow")),
    )
    return (
        cells.select("entity_id", F.explode(axes).alias("axis"), "s", "n")
        .groupBy("entity_id", "axis.month", "axis.dow")
        .agg((F.sum("s") / F.sum("n")).alias("level"))
    )


def month_profile(profiles: DataFrame) -> DataFrame:
    return profiles.where("month IS NOT NULL").select("entity_id", "month", F.col("level").alias("ent_moy_mean"))


def weekday_profile(profiles: DataFrame) -> DataFrame:
    return profiles.where("dow IS NOT NULL").select("entity_id", "dow", F.col("level").alias("ent_dow_mean"))


def profile_arrays(profiles: DataFrame) -> DataFrame:
    """One row per entity: its level by month in ``_months`` and by weekday in ``_weekdays``, NULL where it has none."""
    months = [F.max(F.when(F.col("month") == m, F.col("level"))) for m in range(1, 13)]
    weekdays = [F.max(F.when(F.col("dow") == d, F.col("level"))) for d in range(7)]
    return profiles.groupBy("entity_id").agg(F.array(*months).alias("_months"), F.array(*weekdays).alias("_weekdays"))


# Level name -> its key columns in the scan-shared group table.
GROUP_LEVELS = {
    "district": ("district",),
    "district_month": ("district", "month"),
    "capacity": ("capacity",),
    "district_capacity": ("district", "capacity"),
}


def group_levels(hist: DataFrame) -> DataFrame:
    """Means, counts and load factors of four groupings from one scan.

    Rows collapse to the finest cell (district, capacity, month) first, so the grouping sets only see as
    many rows as there are cells, and no district is ever gathered whole.
    """
    cells = hist.groupBy("district", "capacity", F.month("date").alias("month")).agg(
        F.sum("log_value").alias("s"),
        F.count("log_value").alias("n"),
        F.sum(load_factor(F.col("value"), F.col("capacity"))).alias("lf"),
        F.count("value").alias("lf_n"),
    )
    keys = {name: [F.col(k) for k in cols] for name, cols in GROUP_LEVELS.items()}
    every = [F.col(c) for c in ("district", "capacity", "month")]
    grouped = cells.groupingSets([*keys.values()], *every).agg(
        F.grouping_id().alias("_gid"),
        (F.sum("s") / F.sum("n")).alias("level_mean"),
        F.sum("n").alias("level_n"),
        (F.sum("lf") / F.sum("lf_n")).alias("level_lf"),
    )
    # grouping_id has one bit per key, highest first, set where the key is rolled up.
    bit = {"district": 4, "capacity": 2, "month": 1}
    label = F.lit(None).cast("string")
    for name, cols in GROUP_LEVELS.items():
        gid = sum(b for k, b in bit.items() if k not in cols)
        label = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(label)
    return grouped.withColumn("level", label).drop("_gid")


def level_table(levels: DataFrame, level: str, **columns: str) -> DataFrame:
    """One grouping of ``group_levels`` with its value columns renamed."""
    picked = [F.col(src).alias(dst) for dst, src in columns.items()]
    return levels.where(F.col("level") == level).select(*GROUP_LEVELS[level], *picked)


def capacity_medians(hist: DataFrame) -> DataFrame:
    """Exact median level per rated capacity; a capacity class may hold any share of the rows."""
    return exact_quantiles(hist, ["capacity"], "log_value", {"cap_median": 0.5})


def district_dynamics(hist: DataFrame) -> DataFrame:
    """Heat response and recent level of each district; transfers to entities without history."""
    y = F.col("log_value")
    age = F.datediff(latest_date(hist), F.col("date"))
    out = hist.groupBy("district").agg(
        F.avg(y).alias("_base"),
        safe_slope(y, F.col("cdd22")).alias("dist_cdd_slope"),
        safe_slope(y, F.col("cdd_log")).alias("dist_cddlog_slope"),
        avg_where(y, F.col("cdd22") > 0).alias("dist_summer_mean"),
        avg_where(y, F.col("temperature_2m_mean") > 25.0).alias("_hot"),
        avg_where(y, age < 28).alias("dist_r28_mean"),
        avg_where(y, age < 91).alias("dist_r91_mean"),
        avg_where(1.0 - F.col("is_pos"), age < 28).alias("dist_r28_zero"),
    )
    return out.withColumns(
        {
            "dist_summer_delta": F.col("dist_summer_mean") - F.col("_base"),
            "dist_hot_delta": F.col("_hot") - F.col("_base"),
            "dist_trend": F.col("dist_r28_mean") - F.col("dist_r91_mean"),
        }
    ).drop("_base", "_hot")


def peer_benchmarks(hist: DataFrame, days: int = 91) -> DataFrame:
    """Recent level of comparable capacity classes inside each district."""
    recent = recent_window(hist, days).withColumn("capacity_bucket", capacity_bucket_fixed(F.col("capacity")))
    return (
        recent.where("capacity_bucket IS NOT NULL")
        .groupBy("district", "capacity_bucket")
        .agg(F.avg("log_value").alias("peer_mean"), F.count("*").alias("peer_n"))
    )
