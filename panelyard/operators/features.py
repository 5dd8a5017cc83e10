"""The leak-free feature matrix at any cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.calendar import TURKEY, HolidayCalendar, calendar_features
from panelyard.functions.capacity import capacity_bucket_fixed, daily_limit
from panelyard.operators import history as H
from panelyard.operators.profiles import presence_features
from panelyard.operators.regime import attach_state, detect_regimes, normalize_history
from panelyard.operators.scale import measured_together
from panelyard.session import side_by_side, staged

# Columns of the history that features are made of.
HISTORY = ("entity_id", "date", "value", "log_value", "is_pos", "capacity", "district", "cdd22", "cdd_log", "temperature_2m_mean")


def enrich(panel: DataFrame, weather: DataFrame, holidays: HolidayCalendar = TURKEY) -> DataFrame:
    """Calendar columns, and the weather of the row's district and day. The join moves rows without the calendar, which the date gives."""
    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(weather, ["district", "date"], "left")

    return calendar_features(joined(panel), holidays).select(joined(calendar_features(panel, holidays)).columns)


def same_day_last_year(hist: DataFrame, days: int = 364) -> DataFrame:
    """History shifted forward: a calendar shift, because days can be missing."""
    return hist.select("entity_id", F.date_add("date", days).alias("date"), F.col("log_value").alias("same_day_last_year"))


def attach_features(rows: DataFrame, hist: DataFrame, cutoff: str, presence: bool = False) -> DataFrame:
    """History, group, peer and anchor columns on ``rows``; ``hist`` must end before ``cutoff``.

    Entity-keyed tables and the rows share one partitioning by entity. The group tables are aggregates of
    one scan each; they are measured so that Catalyst broadcasts them while they are small.
    """
    out = rows.withColumn("horizon", F.datediff("date", F.to_date(F.lit(cutoff))))
    if presence:
        out = presence_features(out)
    # The day's join moves rows before they are wide; level, months and weekdays of an entity come as one row.
    own = H.entity_history(hist).join(H.profile_arrays(H.entity_profiles(hist)), "entity_id", "left")
    kept = [c for c in out.columns if c not in ("entity_id", "date", "dow", "month")]
    added = [c for c in own.columns if c not in ("entity_id", "_months", "_weekdays")]
    out = out.join(same_day_last_year(hist), ["entity_id", "date"], "left").join(own, "entity_id", "left")
    out = out.withColumns({"ent_moy_mean": F.get("_months", F.col("month") - 1), "ent_dow_mean": F.get("_weekdays", F.col("dow"))})
    out = out.select("entity_id", "date", "dow", "month", *kept, *added, "ent_moy_mean", "ent_dow_mean", "same_day_last_year")
    groups = measured_together(
        {"levels": H.group_levels(hist), "medians": H.capacity_medians(hist), "dynamics": H.district_dynamics(hist), "peers": H.peer_benchmarks(hist)}
    )
    levels = groups["levels"]
    out = out.join(H.level_table(levels, "district", district_mean="level_mean", district_lf="level_lf"), "district", "left")
    by_month = H.level_table(levels, "district_month", district_moy_mean="level_mean", district_lf_moy="level_lf")
    out = out.join(by_month, ["district", "month"], "left")
    out = out.join(H.level_table(levels, "capacity", cap_mean="level_mean"), "capacity", "left")
    cells = H.level_table(levels, "district_capacity", cell_mean="level_mean", cell_n="level_n")
    out = out.join(cells, ["district", "capacity"], "left")
    out = out.join(groups["medians"], "capacity", "left")
    out = out.join(groups["dynamics"], "district", "left")
    out = out.withColumn("capacity_bucket", capacity_bucket_fixed(F.col("capacity")))
    out = out.join(groups["peers"], ["district", "capacity_bucket"], "left")

    # Ordered fallbacks: own level first, then the (district, capacity) cell, then the district.
    out = out.withColumn("seen", F.col("ent_mean").isNotNull().cast("int"))
    own = {c: F.coalesce(c, "ent_mean") for c in ("ent_moy_mean", "ent_dow_mean", "ent_r7_mean", "ent_r28_mean", "ent_r91_mean")}
    own["same_day_last_year"] = F.coalesce("same_day_last_year", "ent_moy_mean", "ent_mean")
    out = out.withColumns(own)
    group = ("ent_mean", "ent_median", "ent_r7_mean", "ent_r28_mean", "ent_moy_mean", "ent_dow_mean", "same_day_last_year")
    out = out.withColumns({c: F.coalesce(c, "cell_mean", "district_mean") for c in group})
    limit = daily_limit(F.col("capacity"))
    return out.withColumns(
        {
            "log_capacity": F.log1p("capacity"),
            "log_limit": F.log1p(limit),
            "exp_log_district": F.log1p(F.coalesce("district_lf_moy", "district_lf") * limit),
            "exp_log_entity": F.log1p(F.col("ent_lf") * limit),
            "ent_drift_h": F.coalesce("ent_slope90", F.lit(0.0)) * F.col("horizon"),
            "ent_vs_peer": F.col("ent_mean") - F.col("peer_mean"),
        }
    )


def prepared(hist: DataFrame, regime: bool, normalise: bool) -> tuple[DataFrame, DataFrame | None]:
    if not regime:
        return hist, None
    segments, state = detect_regimes(hist)
    if not normalise:
        return hist, state
    return staged(normalize_history(hist.select(*[c for c in HISTORY if c in hist.columns]), segments)), state


def snapshot_block(
    panel: DataFrame, feature_cut: str, start: str, end: str, regime: bool = False, normalise: bool = True,
    presence: bool = False,
) -> DataFrame:
    """Rows of ``[start, end)`` with features from rows strictly before ``feature_cut``."""
    return horizon_block(H.before_cutoff(panel, feature_cut), H.target_window(panel, start, end), feature_cut, regime, normalise, presence)


def horizon_block(
    history: DataFrame, rows: DataFrame, cutoff: str, regime: bool = False, normalise: bool = True, presence: bool = False
) -> DataFrame:
    """Feature matrix of future ``rows`` from all ``history``."""
    hist, state = prepared(history, regime, normalise)
    out = attach_features(rows, hist, cutoff, presence)
    return out if state is None else attach_state(out, state)


def block_number(date: Column, cuts: Sequence[tuple[str, str, str]]) -> Column:
    """0-based number of the target window holding a date; the cuts are a short parameter list."""
    out = F.lit(None).cast("int")
    for i, (_, start, end) in enumerate(cuts):
        inside = (date >= F.to_date(F.lit(start))) & (date < F.to_date(F.lit(end)))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def blocks_by_cut(panel: DataFrame, cuts: Sequence[tuple[str, str, str]], **options) -> DataFrame:
    """Union of snapshot blocks with their 0-based number in ``block``; the group tables of all are made side by side."""

    def block(number: int, cut: str, start: str, end: str) -> DataFrame:
        return snapshot_block(panel, cut, start, end, **options).withColumn("block", F.lit(number))

    parts = side_by_side([lambda i=i, c=c: block(i, *c) for i, c in enumerate(cuts)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def leakage_audit(blocks: DataFrame) -> DataFrame:
    """Per block its date range and whether it starts after the previous block ended. Needs block and date."""
    spans = blocks.groupBy("block").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"))
    # One row per block: the number of blocks is the length of a parameter list.
    previous = F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("causal", F.coalesce(F.col("first") > previous, F.lit(True)))


# Identifiers, targets and helpers that are never model inputs.
NOT_FEATURES = {
    "id", "date", "entity_id", "location", "value", "value_raw", "log_value", "is_pos", "capacity_bucket", "block",
}


def feature_list(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]
