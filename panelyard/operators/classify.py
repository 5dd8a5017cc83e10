"""Rule-based load types of entities with and without history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.calendar import in_dates
from panelyard.functions.rounding import rounded
from panelyard.functions.text import numeric_id
from panelyard.operators.history import avg_where
from panelyard.operators.scale import attach, nearest_within

INACTIVE = "Inactive / Standby"
IRRIGATION = "Agricultural Irrigation"
TOURISM = "Tourism & Seasonal Residential"
BASE_LOAD = "Continuous Base Load & Infrastructure"
INDUSTRY = "Industrial & Manufacturing"
COMMERCE = "Commercial & Services"
RESIDENTIAL = "Urban Residential"

# Local display names of the load types. Lighting is the winter-peaking kind of base load.
LOCAL_NAMES = {
    INACTIVE: "Pasif & Boş / Yedek",
    IRRIGATION: "Tarımsal Sulama",
    TOURISM: "Turizm & Yazlık Konut",
    BASE_LOAD: "Sürekli Baz Yük & Altyapı",
    INDUSTRY: "Sanayi & İmalat",
    COMMERCE: "Ticarethane & Hizmet",
    RESIDENTIAL: "Kentsel Mesken",
}
LIGHTING_LOCAL = "Aydınlatma & Şebeke Altyapısı"


@dataclass(frozen=True)
class DistrictRoles:
    """Which districts of the service area are known for irrigation, tourism, industry and city life."""

    agro: Sequence[str]
    tourism: Sequence[str]
    industry: Sequence[str]
    metro: Sequence[str]
    # Feast days of the reading period that the holiday mean covers.
    feast: Sequence[str] = field(
        default=(
            "2025-03-30", "2025-03-31", "2025-04-01", "2025-06-06", "2025-06-07", "2025-06-08", "2025-06-09",
        )
    )


def load_metrics(hist: DataFrame, roles: DistrictRoles) -> DataFrame:
    """Behaviour of each entity in one aggregate. ``hist`` carries value, capacity and temp_mean."""
    v, t = F.col("value"), F.col("temp_mean")
    month, dow = F.month("date"), F.weekday("date")
    both = v.isNotNull() & t.isNotNull()
    base = hist.groupBy("entity_id").agg(
        F.max("capacity").alias("capacity"),
        F.count(v).alias("days"),
        F.avg(v).alias("mean_t"),
        F.stddev_samp(v).alias("std_t"),
        F.percentile(v, F.array(F.lit(0.5), F.lit(0.9))).alias("_q"),
        F.max(v).alias("max_t"),
        F.min(v).alias("min_t"),
        F.avg((v == 0).cast("double")).alias("zero_ratio"),
        F.avg((v < 1.0).cast("double")).alias("near_zero_ratio"),
        avg_where(v, month.isin(6, 7, 8)).alias("summer_mean"),
        avg_where(v, month.isin(12, 1, 2)).alias("winter_mean"),
        avg_where(v, month.isin(3, 4, 5)).alias("spring_mean"),
        avg_where(v, month.isin(9, 10, 11)).alias("autumn_mean"),
        avg_where(v, dow < 5).alias("wd_mean"),
        avg_where(v, dow >= 5).alias("we_mean"),
        avg_where(v, dow == 6).alias("sun_mean"),
        avg_where(v, in_dates(F.col("date"), roles.feast)).alias("feast_mean"),
        F.count("*").alias("_rows"),
        F.stddev_samp(t).alias("_std_temp"),
        F.corr(F.when(both, v), F.when(both, t)).alias("_corr"),
    )
    full = F.col("capacity") * 24.0
    steady = (F.col("_rows") > 30) & (F.col("std_t") > 0) & (F.col("_std_temp") > 0)
    no_winter = F.col("winter_mean").isNull() | (F.col("winter_mean") < 0.1)

    def per_weekday(top: str) -> Column:
        return F.when(F.col("wd_mean") > 0.1, F.col(top) / F.col("wd_mean")).otherwise(F.lit(1.0))

    return base.withColumns(
        {
            "median_t": F.get("_q", F.lit(0)),
            "p90_t": F.get("_q", F.lit(1)),
            "temp_corr": F.when(steady, F.col("_corr")).otherwise(F.lit(0.0)),
            "load_factor": F.try_divide(F.col("mean_t"), full),
            "p90_load_factor": F.try_divide(F.get("_q", F.lit(1)), full),
            "cv": F.col("std_t") / (F.col("mean_t") + 1e-4),
            "sw_ratio": F.when(no_winter, F.when(F.col("summer_mean") > 5.0, 50.0).otherwise(1.0)).otherwise(
                F.col("summer_mean") / (F.col("winter_mean") + 1e-4)
            ),
            "we_wd_ratio": per_weekday("we_mean"),
            "sun_wd_ratio": per_weekday("sun_mean"),
            "feast_ratio": per_weekday("feast_mean"),
        }
    ).drop("_q", "_rows", "_std_temp", "_corr")


@dataclass(frozen=True)
class Rule:
    """One ordered rule: when it applies, what it says and how sure it is."""

    when: Column
    load_type: str
    confidence: Column
    explanation: Column
    local: str | None = None


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """First matching rule wins; a condition that is NULL does not match."""
    picked = F.lit(None)
    for rule in reversed(rules):
        verdict = F.struct(
            F.lit(rule.load_type).alias("load_type"),
            F.lit(rule.local or LOCAL_NAMES[rule.load_type]).alias("load_type_local"),
            rule.confidence.cast("double").alias("confidence"),
            rule.explanation.alias("explanation"),
        )
        picked = F.when(F.coalesce(rule.when, F.lit(False)), verdict).otherwise(picked)
    return df.withColumn("_rule", picked).select("*", "_rule.*").drop("_rule")


def either(condition: Column, yes: float, no: float) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def classify_load_type(metrics: DataFrame, roles: DistrictRoles) -> DataFrame:
    """Load type of entities with history. ``metrics`` carries the columns of ``load_metrics`` and district."""

    def known(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    place = F.upper("district")
    agro, tour, industry, metro = (place.isin(*names) for names in (roles.agro, roles.tourism, roles.industry, roles.metro))
    mean, zero, near = known("mean_t", 0.0), known("zero_ratio", 0.0), known("near_zero_ratio", 0.0)
    lf, cv, temp = known("load_factor", 0.0), known("cv", 0.0), known("temp_corr", 0.0)
    sw, weekend = known("sw_ratio", 1.0), known("we_wd_ratio", 1.0)
    sunday, feast = known("sun_wd_ratio", 1.0), known("feast_ratio", 1.0)
    kva = known("capacity", 400.0)
    even = weekend.between(0.95, 1.05)
    rules = [
        Rule(
            (zero >= 0.75) | ((mean < 1.0) & (near >= 0.85)),
            INACTIVE,
            either(zero >= 0.90, 0.96, 0.88),
            F.format_string("zero days %.1f%%, daily mean %.2f kWh", rounded(zero * 100, 1), rounded(mean, 2)),
        ),
        Rule(
            ((sw >= 2.2) & agro) | ((sw >= 2.8) & ~tour) | ((sw >= 1.75) & agro & (temp > 0.40)),
            IRRIGATION,
            either((sw >= 2.5) & agro, 0.93, 0.86),
            F.format_string("summer/winter %.2f, temperature correlation %.2f in %s", rounded(sw, 2), rounded(temp, 2), place),
        ),
        Rule(
            tour & ((sw >= 1.6) | ((sw >= 1.35) & (weekend >= 1.02))),
            TOURISM,
            either(sw >= 1.8, 0.91, 0.83),
            F.format_string("coastal %s, summer/winter %.2f, weekend/weekday %.2f", place, rounded(sw, 2), rounded(weekend, 2)),
        ),
        Rule(
            (cv < 0.20) & even & sunday.between(0.95, 1.05),
            BASE_LOAD,
            F.lit(0.89),
            F.format_string("flat profile, variation %.2f, weekend/weekday %.2f", rounded(cv, 2), rounded(weekend, 2)),
        ),
        Rule(
            (sw < 0.70) & even & (temp < -0.30),
            BASE_LOAD,
            F.lit(0.87),
            F.format_string("winter peak, summer/winter %.2f", rounded(sw, 2)),
            local=LIGHTING_LOCAL,
        ),
        Rule(
            ((kva >= 400) & (lf >= 0.30) & sw.between(0.75, 1.45) & ((sunday <= 0.88) | (feast <= 0.80)))
            | (industry & (kva >= 400) & (lf >= 0.25) & (sunday <= 0.85))
            | ((kva >= 630) & (mean >= 4000) & (sunday <= 0.85)),
            INDUSTRY,
            either((lf >= 0.40) & (sunday <= 0.80), 0.92, 0.85),
            F.format_string("%.0f kVA at load factor %.1f%%, Sunday %.2f, feast %.2f", rounded(kva, 0), rounded(lf * 100, 1), rounded(sunday, 2), rounded(feast, 2)),
        ),
        Rule(
            ((sunday <= 0.82) | (weekend <= 0.86)) & (metro | (kva >= 250)),
            COMMERCE,
            either(sunday <= 0.75, 0.87, 0.81),
            F.format_string("weekday load, Sunday %.2f, summer/winter %.2f", rounded(sunday, 2), rounded(sw, 2)),
        ),
        Rule(
            F.lit(True),
            RESIDENTIAL,
            F.lit(0.86),
            F.format_string("balanced seasons %.2f, weekend/weekday %.2f, load factor %.1f%%", rounded(sw, 2), rounded(weekend, 2), rounded(lf * 100, 1)),
        ),
    ]
    return apply_rules(metrics.where(F.col("days") > 0), rules)


def district_type_prior(classified: DataFrame) -> DataFrame:
    """Per district and load type: count, share, and the district's dominant type (first by name on ties)."""
    counts = classified.groupBy("district", "load_type").agg(F.count("*").alias("n"))
    # At most one row per load type and district reaches the window.
    district = Window.partitionBy("district")
    dominant = F.first("load_type").over(district.orderBy(F.col("n").desc(), "load_type"))
    return counts.withColumns(
        {"district_n": F.sum("n").over(district), "share": F.col("n") / F.sum("n").over(district), "dominant": dominant}
    )


def forecast_metrics(forecasts: DataFrame, value: str = "pred") -> DataFrame:
    """Shape of each entity's forecast over the horizon (April to July)."""
    v, month, dow = F.col(value), F.month("date"), F.weekday("date")
    out = forecasts.groupBy("entity_id").agg(
        F.max("capacity").alias("capacity"),
        F.max("district").alias("district"),
        F.avg(v).alias("sub_mean"),
        F.stddev_samp(v).alias("sub_std"),
        F.max(v).alias("sub_max"),
        F.min(v).alias("sub_min"),
        F.avg((v == 0).cast("double")).alias("sub_zero_ratio"),
        avg_where(v, month.isin(6, 7)).alias("_summer"),
        avg_where(v, month.isin(4, 5)).alias("_spring"),
        avg_where(v, dow >= 5).alias("_we"),
        avg_where(v, dow < 5).alias("_wd"),
    )
    return out.withColumns(
        {
            "pred_lf": F.try_divide(F.col("sub_mean"), F.col("capacity") * 24.0),
            "pred_cv": F.col("sub_std") / (F.col("sub_mean") + 1e-4),
            "pred_ramp": F.col("_summer") / (F.col("_spring") + 1e-4),
            "pred_we_wd": F.when(F.col("_wd") > 0.1, F.col("_we") / F.col("_wd")).otherwise(F.lit(1.0)),
        }
    ).drop("_summer", "_spring", "_we", "_wd")


def nearest_neighbour_type(cold: DataFrame, classified: DataFrame, reach: int = 200) -> DataFrame:
    """Add ``neighbor_type``: the type of the closest numbered entity of the district within ``reach``."""
    known = classified.select("district", numeric_id(F.col("entity_id")).alias("num_id"), "load_type")
    asked = cold.withColumn("num_id", numeric_id(F.col("entity_id")))
    return nearest_within(asked, known, "district", "num_id", reach, {"neighbor_type": "load_type"}).drop("num_id")


def classify_cold_load_type(cold: DataFrame, classified: DataFrame, roles: DistrictRoles) -> DataFrame:
    """Load type of entities without history, from forecast shape, numbered neighbour and district prior."""
    prior = district_type_prior(classified).groupBy(F.upper("district").alias("_place")).agg(F.max("dominant").alias("dominant"))
    rows = nearest_neighbour_type(cold, classified).withColumn("_place", F.upper("district"))
    rows = attach(rows, prior, "_place")

    def known(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    place, beside = F.col("_place"), F.coalesce("neighbor_type", F.lit(""))
    agro, tour, industry, metro = (place.isin(*names) for names in (roles.agro, roles.tourism, roles.industry, roles.metro))
    mean, zero, lf = known("sub_mean", 0.0), known("sub_zero_ratio", 0.0), known("pred_lf", 0.0)
    ramp, weekend, kva = known("pred_ramp", 1.0), known("pred_we_wd", 1.0), known("capacity", 400.0)
    rules = [
        Rule(
            (mean < 5.0) | (zero > 0.80), INACTIVE, F.lit(0.85),
            F.format_string("no history; forecast mean %.1f kWh", mean),
        ),
        Rule(
            (agro & (ramp >= 1.12)) | ((ramp >= 1.20) & ~tour) | ((beside == IRRIGATION) & agro),
            IRRIGATION, either(agro, 0.82, 0.75),
            F.format_string("no history; summer ramp %.2f in %s", ramp, place),
        ),
        Rule(
            tour & ((ramp >= 1.08) | (weekend >= 1.0) | (beside == TOURISM)), TOURISM, F.lit(0.84),
            F.format_string("no history; coastal %s", place),
        ),
        Rule(
            (industry & (kva >= 400) & (lf >= 0.08)) | ((kva >= 630) & (beside == INDUSTRY)), INDUSTRY, F.lit(0.81),
            F.format_string("no history; %.0f kVA in %s", kva, place),
        ),
        Rule(
            (metro & (kva >= 250) & (weekend < 0.99)) | (beside == COMMERCE), COMMERCE, F.lit(0.78),
            F.format_string("no history; weekday profile in %s", place),
        ),
        Rule(
            (ramp < 1.03) & (F.abs(weekend - 1.0) < 0.01) & (beside == BASE_LOAD), BASE_LOAD, F.lit(0.77),
            F.lit("no history; flat forecast beside a base-load neighbour"),
        ),
    ]
    for load_type in (*LOCAL_NAMES,):
        rules.append(
            Rule(
                F.coalesce("dominant", F.lit(RESIDENTIAL)) == load_type,
                load_type,
                F.lit(0.80 if load_type == RESIDENTIAL else 0.72),
                F.format_string("no history; dominant type of %s, %.0f kVA", place, kva),
            )
        )
    return apply_rules(rows, rules).drop("_place")


def status_crosstab(entities: DataFrame, statuses: Sequence[str] = ("Seen", "Cold Start", "Train Only")) -> DataFrame:
    """Counts of load type by status, one column per status."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s.lower().replace(" ", "_")) for s in statuses]
    return entities.groupBy("load_type").agg(*counts)


def load_type_mart(entities: DataFrame, classified: DataFrame, metrics: DataFrame) -> DataFrame:
    """Serving table: entity attributes, load type (a default where unclassified) and rounded metrics."""
    digits = {"load_factor": 4, "sw_ratio": 2, "we_wd_ratio": 3, "sun_wd_ratio": 3, "zero_ratio": 3, "temp_corr": 3}
    types = classified.select("entity_id", "load_type", "load_type_local", "confidence", "explanation")
    out = entities.drop("load_type", "load_type_local", "confidence", "explanation").join(types, "entity_id", "left")
    out = out.join(metrics.select("entity_id", *digits), "entity_id", "left")
    return out.withColumns(
        {
            "load_type": F.coalesce("load_type", F.lit(RESIDENTIAL)),
            "load_type_local": F.coalesce("load_type_local", F.lit(LOCAL_NAMES[RESIDENTIAL])),
            "confidence": rounded(F.coalesce("confidence", F.lit(0.70)), 2),
            "explanation": F.coalesce("explanation", F.lit("default for distribution units")),
            "train_days": F.coalesce("train_days", F.lit(0)),
            "train_mean": F.coalesce("train_mean", F.lit(0.0)),
            "pred_mean": F.coalesce("pred_mean", F.lit(0.0)),
            **{c: rounded(c, d) for c, d in digits.items()},
        }
    )
