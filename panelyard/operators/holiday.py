"""Feast response of each entity, and month profiles without feast days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.calendar import TURKEY, in_dates
from panelyard.functions.capacity import load_factor
from panelyard.operators.groups import capacity_edges, shrink, with_capacity_bucket
from panelyard.operators.scale import attach, measured, with_totals

# Days around a feast that form its baseline, feast days needed, and shrinkage counts.
BASELINE_DAYS, MIN_FEAST_DAYS, K_OWN, K_COHORT = 21, 2, 4.0, 5.0


def feast_blocks(days: Sequence[str]) -> list[tuple[str, str]]:
    """(first, last) day of each run of consecutive dates; the list is a short parameter."""
    runs: list[list[dt.date]] = []
    for day in sorted(dt.date.fromisoformat(d) for d in set(days)):
        if runs and (day - runs[-1][1]).days == 1:
            runs[-1][1] = day
        else:
            runs.append([day, day])
    return [(a.isoformat(), b.isoformat()) for a, b in runs]


def feast_deviation(hist: DataFrame, days: Sequence[str] = TURKEY.feast, reach: int = BASELINE_DAYS) -> DataFrame:
    """Per entity: mean over feast blocks of median(feast) - median(surroundings), and the feast days used.

    Blocks become a literal array of intervals; each row is exploded to the blocks whose surroundings
    contain it, which is at most the number of overlapping feasts.
    """
    blocks = F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.to_date(F.lit(a)).alias("first"), F.to_date(F.lit(b)).alias("last"))
            for i, (a, b) in enumerate(feast_blocks(days))
        ]
    )
    day = F.col("date")
    near = F.filter(blocks, lambda b: (day >= F.date_sub(b["first"], reach)) & (day <= F.date_add(b["last"], reach)))
    rows = hist.select("entity_id", "date", "log_value", F.explode(near).alias("b"))
    on_feast = F.col("date").between(F.col("b.first"), F.col("b.last"))
    y = F.col("log_value")
    per_block = rows.groupBy("entity_id", "b.block").agg(
        F.count(F.when(on_feast, 1)).alias("n"),
        F.percentile(F.when(on_feast, y), F.lit(0.5)).alias("feast"),
        F.percentile(F.when(~on_feast, y), F.lit(0.5)).alias("base"),
    )
    usable = per_block.where(F.col("n") >= MIN_FEAST_DAYS).withColumn("d", F.col("feast") - F.col("base"))
    return (
        usable.groupBy("entity_id")
        .agg(F.avg("d").alias("deviation"), F.sum("n").cast("double").alias("feast_days"))
        .where(F.col("deviation").isNotNull())
    )


def feast_response(rows: DataFrame, hist: DataFrame, days: Sequence[str] = TURKEY.feast) -> DataFrame:
    """Add ``feast_dev``: the expected feast deviation on feast rows and exactly zero on all others.

    Own estimate, shrunk to the (district, capacity bucket) cohort, itself shrunk to the fleet.
    """
    edges = measured(capacity_edges(hist))
    own = measured(feast_deviation(hist, days))
    fleet = own.agg(F.coalesce(F.avg("deviation"), F.lit(0.0)).alias("_fleet"))
    meta = hist.groupBy("entity_id").agg(
        F.min_by("district", "date").alias("district"), F.min_by("capacity", "date").alias("capacity")
    )
    members = with_capacity_bucket(meta, edges).join(own, "entity_id")
    cohorts = with_totals(
        members.groupBy("district", "cap_bucket").agg(F.avg("deviation").alias("m"), F.count("*").alias("size")), fleet
    ).select("district", "cap_bucket", shrink(F.col("m"), F.col("size"), F.col("_fleet"), K_COHORT).alias("_cohort"))
    out = with_totals(with_capacity_bucket(rows, edges), fleet)
    out = attach(out, cohorts, ["district", "cap_bucket"])
    out = out.join(own, "entity_id", "left")
    cohort = F.coalesce("_cohort", "_fleet")
    n = F.coalesce("feast_days", F.lit(0.0))
    expected = (n * F.coalesce(F.col("deviation"), cohort) + K_OWN * cohort) / (n + K_OWN)
    on_feast = in_dates(F.col("date"), days)
    return out.withColumn("feast_dev", F.when(on_feast, expected).otherwise(F.lit(0.0))).select(*rows.columns, "feast_dev")


def without_days(hist: DataFrame, days: Sequence[str]) -> DataFrame:
    return hist.where(~in_dates(F.col("date"), days))


def clean_month_profiles(hist: DataFrame, days: Sequence[str] = TURKEY.feast_and_eve) -> DataFrame:
    """The three month aggregates from non-feast days: columns profile, key, month, level."""
    kept = without_days(hist, days)
    cells = kept.groupBy("entity_id", "district", F.month("date").alias("month")).agg(
        F.sum("log_value").alias("s"),
        F.count("log_value").alias("n"),
        F.sum(load_factor(F.col("value"), F.col("capacity"))).alias("lf"),
    )
    kinds = F.array(
        F.struct(F.lit("entity_month").alias("profile"), F.col("entity_id").alias("key"), F.col("s").alias("v")),
        F.struct(F.lit("district_month").alias("profile"), F.col("district").alias("key"), F.col("s").alias("v")),
        F.struct(F.lit("district_lf_month").alias("profile"), F.col("district").alias("key"), F.col("lf").alias("v")),
    )
    return (
        cells.select(F.explode(kinds).alias("k"), "month", "n")
        .groupBy("k.profile", "k.key", "month")
        .agg((F.sum("k.v") / F.sum("n")).alias("level"))
    )


def feast_contamination(hist: DataFrame, days: Sequence[str] = TURKEY.feast_and_eve) -> DataFrame:
    """Per month, the bias feast days cause among entities that run lower at weekends."""
    y, weekend = F.col("log_value"), F.weekday("date") >= 5
    profile = hist.groupBy("entity_id").agg(
        F.avg(F.when(~weekend, y)).alias("weekday"), F.avg(F.when(weekend, y)).alias("weekend")
    )
    industrial = profile.where(F.col("weekday") - F.col("weekend") > 0).select("entity_id")
    feast = in_dates(F.col("date"), days)
    return (
        hist.join(industrial, "entity_id", "left_semi")
        .groupBy(F.month("date").alias("month"))
        .agg(
            F.count("*").alias("rows"),
            F.count(F.when(feast, 1)).alias("feast_rows"),
            F.avg(y).alias("with_feast"),
            F.avg(F.when(~feast, y)).alias("without_feast"),
        )
        .withColumn("bias", F.col("with_feast") - F.col("without_feast"))
    )
