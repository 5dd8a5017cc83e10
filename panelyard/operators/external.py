"""Hourly grid schedules and outages reduced to daily features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.clock import local_midnight
from panelyard.functions.text import norm_place
from panelyard.operators.scale import keep_one


def peak_hour(value: Column) -> Column:
    """First hour of the largest value."""
    return F.max_by("hour", F.struct(value, -F.col("hour")))


def with_trailing(daily: DataFrame, value: str, windows: Sequence[int] = (7, 28), lag_rows: int | None = 364) -> DataFrame:
    """Deviation from the mean of the previous rows (today excluded), and from the row ``lag_rows`` back.

    A national daily series has a few hundred rows a year and one row per day, so a single window
    partition is bounded by the calendar.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy("date")
    out = daily
    for w in windows:
        before = F.avg(value).over(ordered.rowsBetween(-w, -1))
        out = out.withColumn(f"dev_{w}", F.try_divide(F.col(value), before) - 1)
    if lag_rows is not None:
        out = out.withColumn("yoy", F.try_divide(F.col(value), F.lag(value, lag_rows).over(ordered)) - 1)
    return out


def hourly_daily_features(hourly: DataFrame) -> DataFrame:
    """Level, range, peak hour, evening and night share, trailing and yearly deviation per day."""
    v = F.col("value")
    total = F.sum(v)
    daily = hourly.groupBy("date").agg(
        F.avg(v).alias("load_mean"),
        F.max(v).alias("load_max"),
        F.min(v).alias("load_min"),
        (F.max(v) - F.min(v)).alias("load_range"),
        peak_hour(v).alias("peak_hour"),
        F.try_divide(F.sum(F.when(F.col("hour").between(18, 22), v)), total).alias("evening_ratio"),
        F.try_divide(F.sum(F.when(F.col("hour").between(0, 5), v)), total).alias("night_ratio"),
    )
    return with_trailing(daily, "load_mean")


# Which fuels make up each reported share.
FUEL_GROUPS = {
    "gas": ("gas",),
    "wind": ("wind",),
    "solar": ("solar",),
    "hydro": ("dam", "river"),
    "geo": ("geothermal",),
    "coal": ("lignite", "import_coal"),
    "renew": ("wind", "solar", "dam", "river", "geothermal"),
}


def fuel_share_features(hourly: DataFrame, groups: Mapping[str, Sequence[str]] = FUEL_GROUPS) -> DataFrame:
    """Mean total, range, peak hour and fuel shares per day; shares are NULL when the total is zero."""
    total = F.col("total")
    mean = F.avg(total)
    shares = {}
    for name, fuels in groups.items():
        present = [f for f in fuels if f in hourly.columns]
        parts = [F.coalesce(F.avg(f), F.lit(0.0)) for f in present]
        amount = F.lit(0.0)
        for part in parts:
            amount = amount + part
        shares[f"sh_{name}"] = F.try_divide(amount, mean)
    daily = hourly.groupBy("date").agg(
        mean.alias("plan_total"),
        (F.max(total) - F.min(total)).alias("plan_range"),
        peak_hour(total).alias("plan_peak_hour"),
        *[c.alias(n) for n, c in shares.items()],
    )
    return with_trailing(daily, "plan_total", lag_rows=None)


OUTAGE_KINDS = ("planned", "unplanned")
OUTAGE_METRICS = ("n", "minutes", "subscribers", "kwh_lost", "sub_minutes")


def outage_rows(raw: DataFrame, offset_hours: int = 3) -> DataFrame:
    """Clip every outage to its reporting day (local midnight to midnight) and derive the losses.

    ``start_time`` and ``end_time`` are instants; ``date`` is the local day of a fixed UTC offset. An open
    end counts to the end of the day.
    """
    opens = local_midnight(F.col("date"), offset_hours)
    closes = local_midnight(F.date_add("date", 1), offset_hours)
    start = F.greatest(F.col("start_time"), opens)
    end = F.least(F.coalesce(F.col("end_time"), closes), closes)
    seconds = F.unix_micros(end) - F.unix_micros(start)
    minutes = F.when(F.col("start_time").isNotNull(), F.greatest(seconds / 60e6, F.lit(0.0)))
    return (
        raw.withColumn("minutes", minutes)
        .withColumn("subscribers", F.coalesce(F.col("subscribers").cast("double"), F.lit(0.0)))
        .withColumn("hourly_load", F.coalesce(F.col("hourly_load").cast("double"), F.lit(0.0)))
        .withColumn("kwh_lost", F.col("hourly_load") * F.col("minutes") / 60)
        .withColumn("sub_minutes", F.col("subscribers") * F.col("minutes"))
        .withColumn("district", norm_place(F.col("district")))
    )


def outage_daily(raw: DataFrame, kinds: Sequence[str] = OUTAGE_KINDS) -> DataFrame:
    """Province x district x day, one column per kind and metric, zero where nothing happened."""
    rows = outage_rows(raw)
    per_kind = rows.groupBy("province", "district", "date", "kind").agg(
        F.count("outage_id").alias("n"), *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in OUTAGE_METRICS[1:]]
    )
    wide = per_kind.groupBy("province", "district", "date").pivot("kind", list(kinds)).agg(
        *[F.first(m).alias(m) for m in OUTAGE_METRICS]
    )
    columns = {f"outage_{k}_{m}": F.coalesce(F.col(f"{k}_{m}"), F.lit(0)) for k in kinds for m in OUTAGE_METRICS}
    return wide.select("province", "district", "date", *[c.alias(n) for n, c in columns.items()])


def outage_attach(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join on normalised province, leaf district and day; an absent day is a real zero."""
    parts = F.split("location", ">")
    keyed = panel.withColumns(
        {"province": norm_place(F.get(parts, F.lit(0))), "district": norm_place(F.element_at(parts, -1))}
    )
    metrics = [c for c in daily.columns if c.startswith("outage_")]
    named = daily.withColumn("province", norm_place(F.col("province")))
    return keyed.join(named, ["province", "district", "date"], "left").fillna(0, subset=metrics)


def outage_customer_hours(raw: DataFrame) -> DataFrame:
    """District-day totals of a reliability export, one row per outage code.

    Columns: code, province, district, started (timestamp), duration_h, hours_* and customers_*.
    """
    hours = [F.coalesce(F.col(c), F.lit(0.0)) for c in raw.columns if c.startswith("hours_")]
    people = [F.coalesce(F.col(c), F.lit(0)) for c in raw.columns if c.startswith("customers_")]
    unique = keep_one(raw, ["code"], F.col("started"))
    return (
        unique.withColumn("date", F.to_date("started"))
        .where(F.col("date").isNotNull())
        .groupBy("province", "district", "date")
        .agg(
            F.sum(sum(hours, F.lit(0.0))).alias("cust_hours"),
            F.sum(sum(people, F.lit(0))).alias("cust_affected"),
            F.count("*").alias("n_outage"),
            F.max("duration_h").alias("max_dur_h"),
        )
    )
