"""Dormant entities: seasonal wake estimates and forecast floors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.profiles import clip
from panelyard.operators.scale import attach, measured, with_totals


@dataclass(frozen=True)
class WakeParams:
    dormant_window: int = 28
    min_district_obs: int = 30
    own_weight: float = 20.0
    max_level: float = 14.0
    min_wake_p: float = 0.15
    lookback_days: int = 365


def day(date: str) -> Column:
    return F.to_date(F.lit(date))


def dormant_before(hist: DataFrame, when: Column, window: int = 28) -> DataFrame:
    """Entities whose readings over ``[when - window, when)`` are all zero."""
    recent = hist.where((F.col("date") < when) & (F.col("date") >= F.date_sub(when, window)))
    return recent.groupBy("entity_id").agg(F.max("value").alias("_max")).where(F.col("_max") == 0).select("entity_id")


def dormant_until(hist: DataFrame, when: Column, window: int = 28) -> DataFrame:
    """Entities whose readings over ``(when - window, when]`` are all zero."""
    recent = hist.where((F.col("date") <= when) & (F.col("date") > F.date_sub(when, window)))
    return recent.groupBy("entity_id").agg(F.max("value").alias("_max")).where(F.col("_max") == 0).select("entity_id")


def cohort_cells(hist: DataFrame, cutoff: str, params: WakeParams = WakeParams()) -> DataFrame:
    """Entity x month cells of the rows that show what dormant entities did next: rows, active ones and the sum of their levels.

    Those dormant one season before the cutoff, observed from there on; if nobody was, the entities that
    are dormant now. Both cohorts and who belongs to them come from one pass over the history.
    """
    when = day(cutoff)
    reference = F.date_sub(when, params.lookback_days)
    since, active = F.col("date") >= reference, F.col("value") > 0

    def sums(rows: Column) -> Column:
        return F.struct(
            F.count(F.when(rows, 1)).alias("n"),
            F.count(F.when(rows & active, 1)).alias("active"),
            F.sum(F.when(rows & active, F.log1p("value")).otherwise(0.0)).alias("levels"),
        )

    def highest(end: Column) -> Column:
        return F.max(F.when((F.col("date") < end) & (F.col("date") >= F.date_sub(end, params.dormant_window)), F.col("value")))

    rows = hist.where((F.col("date") < when) & F.col("entity_id").isNotNull())
    cells = rows.groupBy("entity_id", "district", "province", F.month("date").alias("month")).agg(
        sums(since).alias("then"), sums(F.lit(True)).alias("now"), highest(reference).alias("_then"), highest(when).alias("_now")
    )
    entity = Window.partitionBy("entity_id")
    asleep = {c: F.coalesce(F.max(c).over(entity) == 0, F.lit(False)) for c in ("_then", "_now")}
    cells = measured(cells.withColumns(asleep).where("_then OR _now"))
    watched = F.col("_then") & (F.col("then.n") > 0)
    any_then = cells.agg(F.count_if(watched) > 0).scalar()
    place = [c for c in cells.columns if c not in ("then", "now", "_then", "_now")]
    then, now = cells.where(watched).select(*place, "then.*"), cells.where("_now").select(*place, "now.*")
    return then.unionByName(now.where(~any_then))


def seasonal_wake_fit(hist: DataFrame, cutoff: str, params: WakeParams = WakeParams()) -> DataFrame:
    """Activity share p, active level L and p*L per (scope, key, month).

    Scopes are entity, district, province and fleet. Rows collapse to entity x month first, so the wider
    scopes are sums over cells and a province holding most rows costs no more than its entities.
    """
    cells = cohort_cells(hist, cutoff, params)
    scopes = F.array(
        F.struct(F.lit("entity").alias("scope"), F.col("entity_id").alias("key"), F.col("month").alias("month")),
        F.struct(F.lit("district").alias("scope"), F.col("district").alias("key"), F.col("month").alias("month")),
        F.struct(F.lit("province").alias("scope"), F.col("province").alias("key"), F.col("month").alias("month")),
        F.struct(F.lit("fleet").alias("scope"), F.lit("all").alias("key"), F.lit(0).alias("month")),
    )
    return (
        cells.select(F.explode(scopes).alias("s"), "n", "active", "levels")
        .groupBy("s.scope", "s.key", "s.month")
        .agg(
            F.sum("n").alias("n"),
            (F.sum("active") / F.sum("n")).alias("p"),
            F.when(F.sum("active") > 0, F.sum("levels") / F.sum("active")).otherwise(0.0).alias("level"),
        )
        .withColumn("p_level", F.col("p") * F.col("level"))
    )


def seasonal_wake_apply(
    rows: DataFrame, hist: DataFrame, cutoff: str, params: WakeParams = WakeParams(), fitted: DataFrame | None = None
) -> DataFrame:
    """Add ``wake``: expected log level of rows of dormant entities where their cohort woke; NULL elsewhere.

    The estimate depends on entity, place and month only, so the scopes meet the grid of these, of dormant entities alone;
    the rows meet one row per entity that holds its cells, so rows dealt by entity are not moved.
    """
    fit = measured(seasonal_wake_fit(hist, cutoff, params) if fitted is None else fitted)
    dormant = dormant_before(hist.where(F.col("date") < day(cutoff)), day(cutoff), params.dormant_window)

    def scope(name: str, key: str) -> DataFrame:
        return fit.where(F.col("scope") == name).select(
            F.col("key").alias(key),
            "month",
            F.col("n").alias(f"_{name}_n"),
            F.col("p").alias(f"_{name}_p"),
            F.col("p_level").alias(f"_{name}_pl"),
        )

    fleet = fit.where("scope = 'fleet'").agg(F.coalesce(F.max("p_level"), F.lit(0.0)).alias("_fleet_pl"))
    cell = ["entity_id", "district", "province", "month"]
    grid = rows.withColumn("month", F.month("date")).select(*cell).join(dormant, "entity_id", "left_semi").distinct()
    out = grid.join(scope("district", "district"), ["district", "month"], "left")
    out = out.join(scope("province", "province"), ["province", "month"], "left")
    out = out.join(scope("entity", "entity_id"), ["entity_id", "month"], "left")
    out = with_totals(out, fleet)
    base = F.coalesce(
        F.when(F.col("_district_n") >= params.min_district_obs, F.col("_district_pl")),
        F.col("_province_pl"),
        F.col("_fleet_pl"),
    )
    weight = F.coalesce(F.col("_entity_n") / (F.col("_entity_n") + params.own_weight), F.lit(0.0))
    estimate = clip(weight * F.coalesce("_entity_pl", F.lit(0.0)) + (1.0 - weight) * base, 0.0, params.max_level)
    woke = F.coalesce("_district_p", "_province_p") >= params.min_wake_p
    cells = measured(out.where(woke).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cell)], estimate.alias("wake")))
    woken = cells.groupBy("_c0").agg(F.collect_list(F.struct("_c1", "_c2", "_c3", "wake")).alias("_cells"))

    def same(c: Column) -> Column:
        return (c["_c3"] == F.month("date")) & c["_c1"].eqNullSafe(F.col("district")) & c["_c2"].eqNullSafe(F.col("province"))

    found = rows.join(woken.hint("shuffle_hash"), F.col("entity_id") == F.col("_c0"), "left")
    return found.select(*rows.columns, F.get(F.filter("_cells", same), F.lit(0))["wake"].alias("wake"))


def blend_wake(prediction: Column, wake: Column, weight: float = 1.0) -> Column:
    """Overwrite, or blend towards, the wake estimate where there is one."""
    return F.when(wake.isNull(), prediction).otherwise(weight * wake + (1.0 - weight) * prediction)


def dormancy_flags(hist: DataFrame, cutoff: str, window: int = 28) -> DataFrame:
    """Dormant entities over ``(cutoff - window, cutoff]`` and whether they were active before."""
    when = day(cutoff)
    upto = hist.where(F.col("date") <= when)
    late = F.col("date") > F.date_sub(when, window)
    return (
        upto.groupBy("entity_id")
        .agg(F.max(F.when(late, F.col("value"))).alias("_late"), F.max(F.when(~late, F.col("value"))).alias("_early"))
        .where(F.col("_late") == 0)
        .select("entity_id", F.coalesce(F.col("_early") > 0, F.lit(False)).alias("prior_active"))
    )


def dormant_floor(rows: DataFrame, hist: DataFrame, floors: DataFrame, cutoff: str, prediction: str = "pred") -> DataFrame:
    """Raise predictions of dormant seen entities to the floor of their (month, prior activity).

    ``floors`` has columns month, prior_active and floor_log: at most 24 rows.
    """
    flags = dormancy_flags(hist, cutoff)
    out = rows.withColumn("month", F.month("date")).join(flags, "entity_id", "left")
    out = attach(out, floors, ["month", "prior_active"])
    floor = F.when(F.col("seen") & F.col("prior_active").isNotNull(), F.col("floor_log"))
    return out.withColumn(prediction, F.greatest(F.col(prediction), floor)).select(rows.columns)
