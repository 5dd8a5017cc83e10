"""Statistical process control over many series.

Series are keyed by ``keys`` and ordered by ``order``, one row per key and order step (a day or an hour), so
a series is as long as its calendar. Shewhart and Nelson are window expressions. EWMA and CUSUM carry
state from row to row; one ordered scan computes both in a single pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.rounding import rounded
from panelyard.operators.scale import BLOCK_ROWS, in_blocks, scan_in_order
from panelyard.session import staged

METHODS = ("shewhart", "ewma", "cusum", "nelson")
# Fixed value: mean moving range of two standard normal draws.
MOVING_RANGE_D2 = 1.128


@dataclass(frozen=True)
class SPCConfig:
    """Limits in baseline sigmas. ``cusum_units='reference'`` scales k and h by the raw baseline sigma
    although the scores are standardised; ``'standard'`` uses k and h as they are."""

    shewhart_multiplier: float = 3.0
    ewma_multiplier: float = 2.66
    ewma_lambda: float = 0.2
    cusum_k: float = 0.5
    cusum_h: float = 4.77
    nelson_threshold: float = 3.0
    min_baseline_points: int = 30
    baseline_fraction: float = 0.5
    min_sigma: float = 1e-6
    cusum_units: str = "reference"

    def __post_init__(self) -> None:
        if not 0 < self.ewma_lambda <= 1:
            raise ValueError(f"ewma_lambda must be in (0, 1], got {self.ewma_lambda}")
        if self.cusum_units not in ("reference", "standard"):
            raise ValueError(f"unknown cusum_units {self.cusum_units!r}")


# Sensitivity presets.
PRESETS = {
    "aggressive": SPCConfig(shewhart_multiplier=2.5, ewma_lambda=0.1, ewma_multiplier=2.0),
    "balanced": SPCConfig(shewhart_multiplier=3.0, ewma_lambda=0.2, ewma_multiplier=2.66),
    "conservative": SPCConfig(shewhart_multiplier=3.5, ewma_lambda=0.3, ewma_multiplier=3.5),
}


def valid_for_spc(df: DataFrame, key: str = "entity_id", value: str = "value") -> DataFrame:
    """Rows with a key and a positive reading."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.col(value) > 0))


def per_series(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def whole_series(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def centered_median_detrend(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "resid", window: int = 21, min_rows: int = 5
) -> DataFrame:
    """log1p of the value minus its centred rolling median.

    Where fewer than ``min_rows`` rows are in reach the nearest known trend is carried in from the later,
    then the earlier side; a series too short for any trend uses its own mean.
    """
    half = window // 2
    centred = per_series(keys, order).rowsBetween(-half, half)
    ahead = per_series(keys, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = per_series(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.col("_log")
    trend = F.when(F.count(y).over(centred) >= min_rows, F.percentile(y, F.lit(0.5)).over(centred))
    return (
        df.withColumn("_log", F.log1p(value))
        .withColumn("_trend", trend)
        .withColumn(
            "_filled",
            F.coalesce(
                F.first("_trend", ignorenulls=True).over(ahead),
                F.last("_trend", ignorenulls=True).over(behind),
                F.avg(y).over(whole_series(keys)),
            ),
        )
        .withColumn(name, y - F.col("_filled"))
        .drop("_log", "_trend", "_filled")
    )


def spc_fit(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Baseline mean, sample sigma and size per series over non-NULL values; empty series are absent."""
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(value).alias("baseline_mean"),
            F.stddev_samp(value).alias("baseline_std"),
            F.count(value).alias("baseline_n"),
        )
        .where(F.col("baseline_n") > 0)
    )


def spc_baseline_split(
    df: DataFrame, keys: Sequence[str], order: str, value: str, raw: str, config: SPCConfig = SPCConfig()
) -> DataFrame:
    """Fit on the first part of each series; flat series (raw sigma zero) and short ones get no baseline."""
    n = F.count("*").over(whole_series(keys))
    position = F.row_number().over(per_series(keys, order))
    size = F.greatest(F.lit(config.min_baseline_points), F.floor(n * config.baseline_fraction))
    flat = F.coalesce(F.stddev_samp(raw).over(whole_series(keys)) == 0, F.lit(False))
    head = df.withColumns({"_flat": flat, "_in": position <= size}).where(~F.col("_flat") & F.col("_in"))
    fit = spc_fit(head, keys, value).where(F.col("baseline_n") >= config.min_baseline_points)
    return fit.withColumn("baseline_std", F.greatest(F.coalesce("baseline_std", F.lit(0.0)), F.lit(config.min_sigma)))


def z_score(value: str = "value") -> Column:
    """Standardised value; zero where the baseline does not vary."""
    return F.when(F.col("baseline_std") > 0, (F.col(value) - F.col("baseline_mean")) / F.col("baseline_std")).otherwise(
        F.when(F.col(value).isNotNull(), F.lit(0.0))
    )


def shewhart(df: DataFrame, keys: Sequence[str], order: str, value: str, config: SPCConfig = SPCConfig()) -> DataFrame:
    """Individuals chart: sigma from the mean moving range of the scored series, or the baseline sigma for
    a single point. Needs the baseline columns."""
    step = F.abs(F.col(value) - F.lag(value).over(per_series(keys, order)))
    spread = F.avg("_step").over(whole_series(keys))
    sigma = F.when(F.count("*").over(whole_series(keys)) > 1, spread / MOVING_RANGE_D2).otherwise(F.col("baseline_std"))
    return (
        df.withColumn("_step", step)
        .withColumn("_sigma", sigma * config.shewhart_multiplier)
        .withColumns(
            {
                "shewhart_upper": F.col("baseline_mean") + F.col("_sigma"),
                "shewhart_lower": F.col("baseline_mean") - F.col("_sigma"),
            }
        )
        .withColumn(
            "shewhart_anomaly",
            F.coalesce(
                (F.col(value) > F.col("shewhart_upper")) | (F.col(value) < F.col("shewhart_lower")), F.lit(False)
            ),
        )
        .drop("_step", "_sigma")
    )


def cusum_step(up: float, down: float, z: float, k: float, h: float) -> tuple[float, float, float, float]:
    """One update: (positive, negative, next positive, next negative); a signal restarts both sides."""
    pos, neg = max(0.0, up + z - k), min(0.0, down + z + k)
    return (pos, neg, 0.0, 0.0) if pos > h or neg < -h else (pos, neg, pos, neg)


def cusum_scale(config: SPCConfig, sigma):
    return sigma if config.cusum_units == "reference" else 1.0


def chart_step(config: SPCConfig):
    """EWMA and CUSUM of one row after the other.

    e0 = x0, then lam*x + (1-lam)*previous; a missing value carries the EWMA and both running sums on.
    """
    lam = config.ewma_lambda

    def start():
        level, up, down = math.nan, 0.0, 0.0

        def step(position, values, means, sigmas) -> list[np.ndarray]:
            nonlocal level, up, down
            ewma, total = np.empty(len(values)), np.empty(len(values))
            rows = zip(position.tolist(), values.tolist(), means.tolist(), sigmas.tolist())
            for i, (at, x, mean, sigma) in enumerate(rows):
                if at == 1:
                    level, up, down = x, 0.0, 0.0
                elif x == x:
                    level = lam * x + (1 - lam) * level
                if x == x:
                    scale = cusum_scale(config, sigma)
                    z = (x - mean) / sigma if sigma > 0 else 0.0
                    pos, neg, up, down = cusum_step(up, down, z, config.cusum_k * scale, config.cusum_h * scale)
                else:
                    pos, neg = up, down
                ewma[i], total[i] = level, abs(pos) + abs(neg)
            shrink = np.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2.0 * position)))
            reach = config.ewma_multiplier * sigmas * shrink
            limit = config.cusum_h * cusum_scale(config, sigmas) * np.ones(len(values))
            with np.errstate(invalid="ignore"):
                return [
                    ewma, means + reach, means - reach, (ewma > means + reach) | (ewma < means - reach), total, limit, total > limit,
                ]

        return step

    return start


CHART_COLUMNS = ("ewma", "ewma_upper", "ewma_lower", "ewma_anomaly", "cusum", "cusum_limit", "cusum_anomaly")


def sequential_charts(
    df: DataFrame, keys: Sequence[str], order: str, value: str, config: SPCConfig = SPCConfig()
) -> DataFrame:
    """EWMA and CUSUM statistics, limits and flags. Needs the baseline columns; one ordered pass for both."""
    added = [T.StructField(n, T.BooleanType() if n.endswith("anomaly") else T.DoubleType()) for n in CHART_COLUMNS]
    return scan_in_order(df, keys, order, added, chart_step(config), [value, "baseline_mean", "baseline_std"])


def block_levels(lam: float):
    """Inside a block: its first present value, the EWMA of the differences to it that starts from zero, and the weight that
    what came before still has. Differences keep a constant series exact."""

    def start():
        base, level, weight = 0.0, 0.0, 1.0

        def step(position, values) -> list[np.ndarray]:
            nonlocal base, level, weight
            bases, levels, weights = (np.empty(len(values)) for _ in range(3))
            for i, (at, x) in enumerate(zip(position.tolist(), values.tolist())):
                if at == 1:
                    base, level, weight = 0.0, 0.0, 1.0
                if x == x:
                    base = x if weight == 1.0 else base
                    level, weight = lam * (x - base) + (1 - lam) * level, weight * (1 - lam)
                bases[i], levels[i], weights[i] = base, level, weight
            return [bases, levels, weights, position.astype(np.int64)]

        return step

    return start


def carry_levels():
    """Over the blocks of a series: the level and the number of rows before each block. A block maps a level e to
    base + level + weight * (e - base), so maps compose and a block is one row whatever it holds."""
    before, rows = math.nan, 0

    def step(position, bases, levels, weights, counts, firsts) -> list[np.ndarray]:
        nonlocal before, rows
        out, offsets = np.empty(len(levels)), np.empty(len(levels), np.int64)
        for i, (at, base, level, weight, count, first) in enumerate(zip(*(a.tolist() for a in (position, bases, levels, weights, counts, firsts)))):
            if at == 1:
                before, rows = first, 0
            out[i], offsets[i] = before, rows
            before, rows = base + level + weight * (before - base), rows + int(count)
        return [out, offsets]

    return step


def ewma(df: DataFrame, keys: Sequence[str], order: str, value: str, config: SPCConfig = SPCConfig(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """EWMA, its limits and flag, for series of any length.

    A table of more than ``block_rows`` rows is cut into ranges of the order column. Every block of a series is scanned by
    itself, which gives an affine map of the level before it; the maps are composed over the series' blocks and applied to
    the rows. So one series is spread over as many tasks as it has blocks, with results of the sequential scan up to
    rounding.
    """
    blocks = in_blocks(df, order, block_rows)
    if blocks is None:
        return sequential_charts(df, keys, order, value, config).drop("cusum", "cusum_limit", "cusum_anomaly")
    lam, names = config.ewma_lambda, [f"_key{i}" for i in range(len(keys))]
    added = [T.StructField(n, T.DoubleType()) for n in ("_base", "_level", "_weight")] + [T.StructField("_place", T.LongType())]
    local = staged(scan_in_order(blocks, [*keys, "_block"], order, added, block_levels(lam), [value]))
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    ends = local.groupBy(*renamed, F.col("_block").alias("_at")).agg(
        F.max_by("_base", "_place").alias("_from"), F.max_by("_level", "_place").alias("_last"), F.max_by("_weight", "_place").alias("_decay"), F.count("*").alias("_rows"),
        F.min_by(F.col(value).cast("double"), "_place").alias("_first"),
    )
    fields = [T.StructField("_before", T.DoubleType()), T.StructField("_offset", T.LongType())]
    carried = scan_in_order(ends, names, "_at", fields, carry_levels, ["_from", "_last", "_decay", "_rows", "_first"]).select(*names, "_at", "_before", "_offset")
    same = F.col("_block") == F.col("_at")
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    level = F.col("_base") + F.col("_level") + F.col("_weight") * (F.col("_before") - F.col("_base"))
    shrink = F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * (F.col("_offset") + F.col("_place")))))
    reach = config.ewma_multiplier * F.col("baseline_std") * shrink
    out = local.join(carried, same).withColumns({"ewma": F.when(~F.isnan(level), level), "ewma_upper": F.col("baseline_mean") + reach, "ewma_lower": F.col("baseline_mean") - reach})
    flagged = F.coalesce((F.col("ewma") > F.col("ewma_upper")) | (F.col("ewma") < F.col("ewma_lower")), F.lit(False))
    return out.withColumn("ewma_anomaly", flagged).select(*df.columns, "ewma", "ewma_upper", "ewma_lower", "ewma_anomaly")


def cusum(df: DataFrame, keys: Sequence[str], order: str, value: str, config: SPCConfig = SPCConfig()) -> DataFrame:
    return sequential_charts(df, keys, order, value, config).drop("ewma", "ewma_upper", "ewma_lower", "ewma_anomaly")


# Run rules as (rows in the window, rows that must agree, beyond how many sigmas).
RUN_RULES = {"nelson_r2": (9, 9, 0.0), "nelson_r5": (3, 2, 2.0), "nelson_r6": (5, 4, 1.0)}
TREND_ROWS = 6


def nelson_rules(df: DataFrame, keys: Sequence[str], order: str, value: str, config: SPCConfig = SPCConfig()) -> DataFrame:
    """Rule 1 (beyond the threshold), 2 (nine on one side), 3 (six rising or falling), 5 (two of three beyond
    two sigmas), 6 (four of five beyond one sigma). Every row of a hitting window is flagged. All windows
    share one sort; a series with zero sigma is never flagged."""
    ordered = per_series(keys, order)
    varies = F.col("baseline_std") > 0

    def count(condition: Column, rows: int) -> Column:
        return F.count(F.when(condition, 1)).over(ordered.rowsBetween(1 - rows, Window.currentRow))

    z = F.col("_z")
    out = df.withColumn("_z", F.when(varies, (F.col(value) - F.col("baseline_mean")) / F.col("baseline_std"))).withColumns(
        {"_row": F.row_number().over(ordered), "_dz": z - F.lag("_z").over(ordered)}
    )
    hits = {}
    for name, (rows, agree, sigmas) in RUN_RULES.items():
        one_side = (count(z > sigmas, rows) >= agree) | (count(z < -sigmas, rows) >= agree)
        hits[name] = (one_side & (F.col("_row") >= rows), rows)
    steps = TREND_ROWS - 1
    trend = (count(F.col("_dz") > 0, steps) == steps) | (count(F.col("_dz") < 0, steps) == steps)
    hits["nelson_r3"] = (trend & (F.col("_row") >= TREND_ROWS), TREND_ROWS)
    out = out.withColumns({f"_{n}": hit.cast("int") for n, (hit, _) in hits.items()})
    flags = {"nelson_r1": F.coalesce(F.abs(z) > config.nelson_threshold, F.lit(False))}
    for name, (_, rows) in hits.items():
        flags[name] = F.max(f"_{name}").over(ordered.rowsBetween(Window.currentRow, rows - 1)) == 1
    out = out.withColumns({n: flags[n] for n in sorted(flags)})
    any_rule = F.lit(False)
    for name in sorted(flags):
        any_rule = any_rule | F.col(name)
    return out.withColumn("nelson_anomaly", F.coalesce(varies & any_rule, F.lit(False))).drop(
        "_z", "_dz", "_row", *[f"_{n}" for n in hits]
    )


def combine_methods(df: DataFrame, methods: Sequence[str] = METHODS, aggregate: str = "majority") -> DataFrame:
    """Count the charts that flag a row (0..len(methods)) and combine them."""
    flagged = sum((F.col(f"{m}_anomaly").cast("int") for m in methods), F.lit(0))
    verdicts = {
        "any": F.col("n_methods_flagged") > 0,
        "majority": F.col("n_methods_flagged") * 2 > len(methods),
        "all": F.col("n_methods_flagged") == len(methods),
    }
    if aggregate not in verdicts:
        raise ValueError(f"unknown aggregation {aggregate!r}")
    return df.withColumn("n_methods_flagged", flagged).withColumn("is_anomaly", verdicts[aggregate])


def spc_detect(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    methods: Sequence[str] = METHODS,
    aggregate: str = "any",
    config: SPCConfig = SPCConfig(),
) -> DataFrame:
    """Charts and verdict for rows that carry baseline columns."""
    out = df
    if "shewhart" in methods:
        out = shewhart(out, keys, order, value, config)
    if "nelson" in methods:
        out = nelson_rules(out, keys, order, value, config)
    if {"ewma", "cusum"} & set(methods):
        out = sequential_charts(out, keys, order, value, config)
    return combine_methods(out, methods, aggregate)


def spc_detect_multi(
    df: DataFrame,
    baselines: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    methods: Sequence[str] = METHODS,
    aggregate: str = "majority",
    config: SPCConfig = SPCConfig(),
) -> DataFrame:
    """Score every series in one pass; rows of series without a baseline are kept and never flagged, because
    no chart can compare with a missing limit."""
    scored = spc_detect(df.join(baselines, list(keys), "left"), keys, order, value, methods, aggregate, config)
    return scored.select(*df.columns, *[f"{m}_anomaly" for m in methods], "n_methods_flagged", "is_anomaly")


def spc_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    flagged = F.col("is_anomaly").cast("int")
    return results.groupBy(*keys).agg(
        F.sum(flagged).alias("anomaly_count"),
        rounded(F.avg(flagged), 4).alias("anomaly_rate"),
        rounded(F.avg("n_methods_flagged"), 4).alias("avg_methods_flagged"),
        F.max("n_methods_flagged").alias("max_methods_flagged"),
    )


def spc_top_report(results: DataFrame, keys: Sequence[str], order: str, top: int = 100) -> DataFrame:
    """The ``top`` flagged rows by number of agreeing charts; key and order break ties."""
    return (
        results.where("is_anomaly").orderBy(F.col("n_methods_flagged").desc(), *[F.col(k) for k in (*keys, order)]).limit(top)
    )


def rolling_anomaly_density(df: DataFrame, keys: Sequence[str], order: str, window: int = 7) -> DataFrame:
    """Flags in the trailing window; NULL until the window is full."""
    trailing = per_series(keys, order).rowsBetween(1 - window, Window.currentRow)
    density = F.when(F.count("*").over(trailing) == window, F.sum(F.col("is_anomaly").cast("int")).over(trailing))
    return df.withColumn("anomaly_density", density.cast("double"))


def days_since_anomaly(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows since the last flag, zero on it, infinite before the first."""
    ordered = per_series(keys, order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_row", F.row_number().over(ordered))
    last = F.max(F.when(F.col("is_anomaly"), F.col("_row"))).over(upto)
    since = F.coalesce((F.col("_row") - last).cast("double"), F.lit(float("inf")))
    return out.withColumn("days_since_anomaly", since).drop("_row")


def spc_features(
    df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 7, config: SPCConfig = SPCConfig()
) -> DataFrame:
    """Model features from the charts: score, z, flag, days since, density, EWMA trend and deviation."""
    scored = spc_detect(df, keys, order, value, METHODS, "any", config)
    scored = days_since_anomaly(rolling_anomaly_density(scored, keys, order, window), keys, order)
    z = F.when(F.col("baseline_std") > 0, (F.col(value) - F.col("baseline_mean")) / F.col("baseline_std"))
    return scored.select(
        *df.columns,
        F.col("n_methods_flagged").alias("anomaly_score"),
        z.alias("z_score"),
        F.abs(z).alias("distance_from_center"),
        "is_anomaly",
        "days_since_anomaly",
        "anomaly_density",
        F.col("ewma").alias("ewma_trend"),
        (F.col(value) - F.col("ewma")).alias("deviation_from_ewma"),
    )


def spc_segments(scored: DataFrame) -> DataFrame:
    """One row per (row, segment): normal, one-chart-only and multiple; segments overlap."""
    s, e, c = (F.col(f"{m}_anomaly") for m in ("shewhart", "ewma", "cusum"))
    agreeing = s.cast("int") + e.cast("int") + c.cast("int")
    members = {
        "normal": ~F.col("is_anomaly"),
        "shewhart_only": s & ~e & ~c,
        "ewma_only": e & ~s,
        "cusum_only": c & ~s,
        "multiple_methods": agreeing >= 2,
    }
    names = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in members.items()]))
    return scored.withColumn("segment", F.explode(names))


def apply_anomaly_strategy(
    df: DataFrame, keys: Sequence[str], order: str, value: str, strategy: str = "remove", config: SPCConfig = SPCConfig()
) -> DataFrame:
    """Remove flagged rows, clip values to the Shewhart limits, or add the flag. Needs baseline columns."""
    if strategy == "clip":
        out = shewhart(df, keys, order, value, config)
        clipped = F.greatest("shewhart_lower", F.least("shewhart_upper", value))
        return out.withColumn(value, F.when(F.col(value).isNotNull(), clipped)).select(df.columns)
    scored = spc_detect(df, keys, order, value, METHODS, "any", config).select(*df.columns, "is_anomaly")
    if strategy == "remove":
        return scored.where(~F.col("is_anomaly")).drop("is_anomaly")
    if strategy == "flag":
        return scored
    raise ValueError(f"unknown strategy {strategy!r}")


def stratified_split(
    df: DataFrame, id_columns: Sequence[str], flag: str = "is_anomaly", test_size: float = 0.2, seed: int = 42,
    stratify: bool = True,
) -> DataFrame:
    """Add ``is_test``: a seeded share of the rows, the same share of flagged and of normal ones.

    Rows are ranked by a hash of their id inside hash buckets of a stratum, so no stratum is ever sorted in
    one task. A running count per bucket turns the bucket ranks into stratum ranks, which makes the number
    of test rows exact.
    """
    stratum = F.col(flag) if stratify else F.lit(True)
    # 60 bits of a digest; its top 16 choose the bucket, so buckets are ordered like the number itself.
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_columns]).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = df.withColumns({"_s": stratum, "_h": draw}).withColumn("_b", F.shiftright("_h", 44).cast("int"))
    sizes = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    by_stratum = Window.partitionBy("_s")
    before = by_stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_total": F.sum("_n").over(by_stratum),
        }
    ).select("_s", "_b", "_before", "_total")
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", *id_columns))
    ranked = rows.withColumn("_rank", rank).join(offsets, ["_s", "_b"])
    chosen = F.col("_before") + F.col("_rank") <= F.round(F.col("_total") * test_size)
    return ranked.withColumn("is_test", chosen).select(*df.columns, "is_test")


def split_report(split: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Size and flag rate (percent) of both parts."""
    return split.groupBy("is_test").agg(
        F.count("*").alias("rows"), (F.avg(F.col(flag).cast("double")) * 100).alias("anomaly_rate_pct")
    )
