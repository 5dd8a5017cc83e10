"""Change points in entity histories: where the level broke, what kind of break it was, and the factor that
restates older readings in today's units.

Everything is a window or an aggregate keyed by entity, whose rows are one per day. All windows partition
by entity (or entity and segment, which the same shuffle satisfies), so detection costs one exchange. The exchange has a partition
per so many rows, so a task needs no more memory for a larger fleet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.scale import latest_date, measured, spread

# Amplification rates that a change of meter settings can multiply readings by, ascending.
SCALE_RATES = (
    2, 2.5, 3, 4, 5, 6, 8, 10, 12, 15, 20, 24, 25, 30, 40, 50, 60, 75, 80, 100, 120, 125, 150, 160, 200,
    240, 250, 300, 400, 500, 600, 800, 1000,
)
BREAK_CODES = {"none": 0, "step": 1, "scale": 2, "wake": 3, "sleep": 4}


@dataclass(frozen=True)
class RegimeParams:
    min_seg: int = 21
    probe: int = 28
    tau: float = 0.35
    max_breaks: int = 4
    dormant_frac: float = 0.80
    rate_tol: float = 0.18
    abrupt_days: int = 3
    shape_corr: float = 0.55
    min_obs: int = 60
    min_positive: int = 5
    min_weekdays: int = 4


def by_day():
    return Window.partitionBy("entity_id").orderBy("date")


def window_median_contrast(hist: DataFrame, params: RegimeParams = RegimeParams()) -> DataFrame:
    """Add ``pos`` (0-based row), ``n`` and ``contrast``: the gap between the medians of the ``probe`` rows
    from here on and of the ``probe`` rows before, in log space; NULL unless both are full.

    The gap is rounded to nine digits, so that equal gaps compare equal whatever the summation order.
    """
    w = params.probe
    y = F.col("_log")
    # the median of the probe before a row is the one that began there: each median is taken once
    out = spread(hist, "entity_id").withColumn("_log", F.log1p("value")).withColumns(
        {
            "pos": F.row_number().over(by_day()) - 1,
            "n": F.count("*").over(Window.partitionBy("entity_id")),
            "_right": F.percentile(y, F.lit(0.5)).over(by_day().rowsBetween(0, w - 1)),
        }
    )
    gap = F.round(F.abs(F.col("_right") - F.lag("_right", w).over(by_day())), 9)
    full = (F.col("pos") >= w) & (F.col("pos") + w <= F.col("n"))
    return out.withColumn("_gap", gap).withColumn("contrast", F.when(full, F.col("_gap"))).drop("_log", "_right", "_gap")


def segment_breaks(hist: DataFrame, params: RegimeParams = RegimeParams()) -> DataFrame:
    """Add ``seg`` (0-based) and the segment's first row ``seg_lo`` by repeated splitting.

    Each round splits every segment at its largest contrast (the earliest on ties) if that reaches ``tau``
    and both probes fit inside the segment. A segment that did not split keeps its rows and cannot split
    later, so ``max_breaks`` rounds equal a recursion of that depth; entities run in parallel.
    """
    margin = max(params.min_seg, params.probe)
    out = window_median_contrast(hist, params).withColumns({"seg_lo": F.lit(0), "_hi": F.col("n").cast("int")})
    for _ in range(params.max_breaks):
        segment = Window.partitionBy("entity_id", "seg_lo")
        fits = (F.col("pos") >= F.col("seg_lo") + margin) & (F.col("pos") <= F.col("_hi") - margin)
        wide = (F.col("_hi") - F.col("seg_lo") >= 2 * params.min_seg) & (F.col("n") >= params.min_obs)
        candidate = F.when(
            fits & wide & (F.col("contrast") >= params.tau), F.struct(F.col("contrast"), (-F.col("pos")).alias("back"))
        )
        out = out.withColumn("_cut", -F.max(candidate).over(segment)["back"])
        right = F.coalesce(F.col("pos") >= F.col("_cut"), F.lit(False))
        split = F.col("_cut").isNotNull()
        out = out.withColumns(
            {
                "seg_lo": F.when(right, F.col("_cut")).otherwise(F.col("seg_lo")),
                "_hi": F.when(split & ~right, F.col("_cut")).otherwise(F.col("_hi")),
            }
        ).drop("_cut")
    return out.withColumn("seg", F.dense_rank().over(Window.partitionBy("entity_id").orderBy("seg_lo")) - 1).drop("_hi")


def segment_stats(segmented: DataFrame) -> DataFrame:
    """Start, end, length, median positive level, zero share and weekday shape of every segment."""
    v = F.col("value")
    level = F.percentile(F.when(v > 0, v), F.lit(0.5))
    logs = F.when(v > 0, F.log1p("value"))
    shape = [F.avg(F.when(F.weekday("date") == d, logs)) for d in range(7)]
    return segmented.groupBy("entity_id", "seg").agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count("*").alias("n"),
        F.coalesce(level, F.lit(0.0)).alias("level"),
        F.avg((v <= 0).cast("double")).alias("zero_frac"),
        F.count(F.when(v > 0, 1)).alias("n_positive"),
        F.min_by("capacity", "date").alias("capacity"),
        F.array(*shape).alias("shape"),
    )


def shape_correlation(a: Column, b: Column) -> tuple[Column, Column]:
    """(weekdays known on both sides, Pearson correlation over them) of two seven-day profiles."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())

    def total(f) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p["a"], p["b"]))

    n = F.size(pairs).cast("double")
    mean_a, mean_b = F.try_divide(total(lambda x, y: x), n), F.try_divide(total(lambda x, y: y), n)
    sxy = total(lambda x, y: (x - mean_a) * (y - mean_b))
    sxx = total(lambda x, y: (x - mean_a) * (x - mean_a))
    syy = total(lambda x, y: (y - mean_b) * (y - mean_b))
    return F.size(pairs), F.try_divide(sxy, F.sqrt(sxx * syy))


def classify_breaks(stats: DataFrame, params: RegimeParams = RegimeParams()) -> DataFrame:
    """Label the boundary after every segment: ``break_after`` and ``ratio_after``.

    sleep / wake: the zero share crosses the dormant share. none: too few positive readings. scale: an
    abrupt change by a standard rate that keeps the weekday shape or passes the rated capacity. step: any
    other change. The last segment of an entity has no boundary.
    """
    ordered = Window.partitionBy("entity_id").orderBy("seg")
    following = {c: F.lead(c).over(ordered).alias(f"_{c}") for c in ("start", "level", "zero_frac", "n_positive", "shape")}
    pairs = stats.select("*", *following.values())
    limit = F.col("capacity") * 24.0
    before, after = F.col("level"), F.col("_level")
    enough = (F.col("n_positive") >= params.min_positive) & (F.col("_n_positive") >= params.min_positive)
    ratio = F.when(enough, F.try_divide(after, before))
    size = F.greatest(ratio, F.try_divide(F.lit(1.0), ratio))
    rates = F.array(*[F.lit(float(r)) for r in SCALE_RATES])
    off_rate = F.array_min(F.transform(rates, lambda r: F.abs(r - size) / r))
    on_rate = (off_rate < params.rate_tol) & (size >= 2.0)
    days, corr = shape_correlation(F.col("shape"), F.col("_shape"))
    same_shape = (days >= params.min_weekdays) & (F.coalesce(corr, F.lit(-1.0)) >= params.shape_corr)
    impossible = (limit > 0) & ((after > limit) | (before > limit))
    abrupt = F.datediff(F.col("_start"), F.col("end")) <= params.abrupt_days
    asleep, dozing = F.col("_zero_frac") >= params.dormant_frac, F.col("zero_frac") >= params.dormant_frac
    kind = (
        F.when(F.col("_start").isNull(), "none")
        .when(asleep & ~dozing, "sleep")
        .when(dozing & ~asleep, "wake")
        .when(~enough, "none")
        .when(on_rate & abrupt & (same_shape | impossible), "scale")
        .otherwise("step")
    )
    value = (
        F.when(F.col("break_after") == "sleep", F.lit(0.0))
        .when(F.col("break_after") == "wake", F.lit(float("inf")))
        .when(F.col("break_after") == "none", F.lit(1.0))
        .otherwise(ratio)
    )
    return (
        pairs.withColumn("break_after", kind)
        .withColumn("ratio_after", value)
        .drop("shape", *[f"_{c}" for c in following])
    )


def carry_factors(labelled: DataFrame) -> DataFrame:
    """Add ``to_current``: the product of the scale ratios from this segment's end to today.

    Only changes of units are carried; a genuine step is a change of load.
    """
    onward = Window.partitionBy("entity_id").orderBy("seg").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    unit_change = (F.col("break_after") == "scale") & (F.col("ratio_after") > 0)
    step = F.when(unit_change, F.ln("ratio_after")).otherwise(F.lit(0.0))
    return labelled.withColumn("_ln", step).withColumn("to_current", F.exp(F.sum("_ln").over(onward))).drop("_ln")


def regime_segments(hist: DataFrame, params: RegimeParams = RegimeParams()) -> DataFrame:
    """Segments of every entity with kind, ratio and carry factor."""
    rows = hist.select("entity_id", "date", "value", "capacity")
    return carry_factors(classify_breaks(segment_stats(segment_breaks(rows, params)), params))


def regime_state(segments: DataFrame, cutoff: Column, params: RegimeParams = RegimeParams()) -> DataFrame:
    """One row per entity: the current segment and the break that led to it. ``cutoff`` is the last day of
    the whole history."""
    ordered = Window.partitionBy("entity_id").orderBy("seg")
    last = Window.partitionBy("entity_id")
    marked = segments.withColumns(
        {
            "_kind": F.lag("break_after").over(ordered),
            "_ratio": F.lag("ratio_after").over(ordered),
            "_first": F.first("to_current").over(ordered),
            "_last": F.max("seg").over(last),
        }
    )
    limit = F.col("capacity") * 24.0
    return marked.where(F.col("seg") == F.col("_last")).select(
        "entity_id",
        F.log1p("level").alias("regime_level"),
        (F.datediff(cutoff, F.col("start")) + 1).alias("regime_days"),
        F.col("zero_frac").alias("regime_zero_frac"),
        F.col("seg").alias("regime_n_breaks"),
        F.coalesce("_kind", F.lit("none")).alias("regime_last_break"),
        F.least(F.greatest(F.coalesce("_ratio", F.lit(1.0)), F.lit(0.0)), F.lit(1e6)).alias("regime_last_ratio"),
        F.col("_first").alias("regime_scale_to_current"),
        (F.col("zero_frac") >= params.dormant_frac).cast("int").alias("regime_is_dormant"),
        ((limit > 0) & (F.col("level") > limit)).cast("int").alias("regime_cap_violation"),
    )


def detect_regimes(hist: DataFrame, params: RegimeParams = RegimeParams()) -> tuple[DataFrame, DataFrame]:
    """(segments, state) of strictly pre-cutoff history."""
    segments = measured(regime_segments(hist, params))
    return segments, regime_state(segments, latest_date(hist), params)


STATE_DEFAULTS = {
    "regime_days": 0,
    "regime_zero_frac": 0.0,
    "regime_n_breaks": 0,
    "regime_last_ratio": 1.0,
    "regime_scale_to_current": 1.0,
    "regime_is_dormant": 0,
    "regime_cap_violation": 0,
}


def attach_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """State columns on every row; the break kind as its code, defaults for entities without history."""
    out = rows.join(state, "entity_id", "left")
    code = F.lit(0)
    for kind, number in BREAK_CODES.items():
        code = F.when(F.col("regime_last_break") == kind, F.lit(number)).otherwise(code)
    return out.withColumn("regime_last_break", code).fillna(STATE_DEFAULTS)


def normalize_history(hist: DataFrame, segments: DataFrame) -> DataFrame:
    """Restate history in current units. ``value`` is replaced and the reading is kept as ``value_raw``."""
    # An entity has few segments: they come as one row per entity, of which a reading takes the last that began by its day.
    start = F.struct("start", "to_current")
    starts = measured(segments.groupBy(F.col("entity_id").alias("_entity")).agg(F.array_sort(F.collect_list(start)).alias("_starts")))
    begun = F.filter("_starts", lambda s: s["start"].isNull() | (s["start"] <= F.col("date")))
    factor = F.get(begun, F.size(begun) - 1)["to_current"]
    return (
        hist.join(starts, F.col("entity_id").eqNullSafe(F.col("_entity")), "left")
        .withColumn("value_raw", F.col("value"))
        .withColumn("value", F.col("value_raw") * F.coalesce(factor, F.lit(1.0)))
        .withColumns({"log_value": F.log1p("value"), "is_pos": (F.col("value") > 0).cast("int")})
        .drop("_entity", "_starts")
    )
