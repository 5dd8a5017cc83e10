"""Where forecast error comes from: segments, bias along a feature, worst rows, candidate against base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.evaluate import monotonic
from panelyard.operators.scale import exact_quantiles, with_totals

MIN_ROWS = 30


def add_error_columns(df: DataFrame, y: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    err = F.col(pred).cast("double") - F.col(y).cast("double")
    if weight is not None:
        err = err * F.sqrt(F.col(weight).cast("double"))
    return df.withColumn("err", err).withColumns({"sq_err": F.col("err") * F.col("err"), "abs_err": F.abs("err")})


def segment_report(df: DataFrame, by: Sequence[str], min_n: int = MIN_ROWS, top: int = 20) -> DataFrame:
    """Segments by their share of the total squared error; lift compares it with their share of the rows."""
    cells = df.groupBy(*by).agg(
        F.count("sq_err").alias("n"),
        F.sqrt(F.avg("sq_err")).alias("rmsle"),
        F.avg("err").alias("bias"),
        F.sum("sq_err").alias("_sq"),
    )
    totals = cells.agg(F.sum("_sq").alias("_all_sq"), F.sum("n").alias("_all_n"))
    out = with_totals(cells, totals).withColumns(
        {
            "share_of_rows": F.col("n") / F.col("_all_n"),
            "share_of_error": F.when(F.col("_all_sq") > 0, F.col("_sq") / F.col("_all_sq")).otherwise(F.lit(0.0)),
        }
    )
    out = out.withColumn("lift", F.try_divide(F.col("share_of_error"), F.col("share_of_rows")))
    kept = out.where(F.col("n") >= min_n).drop("_sq", "_all_sq", "_all_n")
    return kept.orderBy(F.col("share_of_error").desc(), *by).limit(top)


def quantile_bins(df: DataFrame, feature: str, bins: int = 10) -> DataFrame:
    """Add ``bin``: the 0-based right-closed quantile interval of the feature, repeated edges merged."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, [], feature, probs).select(F.array_sort(F.array_distinct(F.array(*probs))).alias("_edges"))
    placed = with_totals(df.where(F.col(feature).isNotNull()), edges)
    # Right-closed: a value on an edge belongs below it; the lowest edge belongs to the first bin.
    below = F.size(F.filter("_edges", lambda e: e < F.col(feature)))
    return placed.withColumn("bin", F.greatest(below - 1, F.lit(0))).drop("_edges")


def bias_curve(df: DataFrame, feature: str, bins: int = 10, min_n: int = MIN_ROWS) -> DataFrame:
    """Error per quantile bin of a feature, with ``monotonic_bias`` true when the bias never turns.

    The curve has at most ``bins`` rows.
    """
    curve = (
        quantile_bins(df, feature, bins)
        .groupBy("bin")
        .agg(
            F.count("err").alias("n"),
            F.avg(feature).alias("feature_mean"),
            F.sqrt(F.avg("sq_err")).alias("rmsle"),
            F.avg("err").alias("bias"),
        )
        .where(F.col("n") >= min_n)
    )
    biases = F.transform(F.array_sort(F.collect_list(F.struct("bin", "bias"))), lambda b: b["bias"])
    return with_totals(curve, curve.agg(monotonic(biases).alias("monotonic_bias")))


def worst_cases(df: DataFrame, id_cols: Sequence[str], k: int = 25, extra: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest absolute error (top-k, never a full sort); ids break ties."""
    columns = list(dict.fromkeys([*id_cols, "err", "abs_err", *extra]))
    return df.orderBy(F.col("abs_err").desc(), *id_cols).limit(k).select(*columns)


def aligned(base: DataFrame, cand: DataFrame, ids: Sequence[str], y: str, pred: str, groups: Sequence[str]) -> DataFrame:
    left = base.select(*ids, y, F.col(pred).alias("pred_base"), *groups)
    right = cand.select(*ids, F.col(pred).alias("pred_cand"))
    rows = left.join(right, list(ids))
    eb, ec = F.col("pred_base") - F.col(y), F.col("pred_cand") - F.col(y)
    return rows.withColumns({"sq_base": eb * eb, "sq_cand": ec * ec})


def compare_predictions(
    base: DataFrame, cand: DataFrame, ids: Sequence[str], groups: Sequence[str], y: str = "y", pred: str = "pred",
    min_n: int = MIN_ROWS, noise_floor: float = 0.005,
) -> DataFrame:
    """Per segment: both errors, their difference, a verdict against the noise floor, and the overall delta."""
    rows = aligned(base, cand, ids, y, pred, groups)
    table = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum("sq_base").alias("_b"), F.sum("sq_cand").alias("_c")
    )
    overall = table.agg(
        (F.sqrt(F.sum("_c") / F.sum("n")) - F.sqrt(F.sum("_b") / F.sum("n"))).alias("overall_delta")
    )
    out = with_totals(table, overall).withColumns(
        {"rmsle_base": F.sqrt(F.col("_b") / F.col("n")), "rmsle_cand": F.sqrt(F.col("_c") / F.col("n"))}
    )
    out = out.withColumn("delta", F.col("rmsle_cand") - F.col("rmsle_base"))
    verdict = F.when(F.col("delta") <= -noise_floor, "improved").when(F.col("delta") >= noise_floor, "regressed")
    return out.withColumn("verdict", verdict.otherwise("same")).where(F.col("n") >= min_n).drop("_b", "_c")


def error_report(
    df: DataFrame, groups: Sequence[str], features: Sequence[str] = (), ids: Sequence[str] = (), y: str = "y",
    pred: str = "pred", min_n: int = MIN_ROWS, top: int = 15, k: int = 20, bins: int = 10,
) -> DataFrame:
    """All of the above in one long table: section, key, metric, value. Each section is report-sized."""
    work = add_error_columns(df, y, pred)

    def melt(frame: DataFrame, section: str, key, names: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return frame.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.explode(pairs).alias("p")).select(
            "section", "key", "p.metric", "p.value"
        )

    overall = work.agg(F.count("*").alias("n"), F.sqrt(F.avg("sq_err")).alias("rmsle"), F.avg("err").alias("bias"))
    out = melt(overall, "overall", F.lit("all"), ["n", "rmsle", "bias"])
    for g in groups:
        report = segment_report(work, [g], min_n, top)
        out = out.unionByName(melt(report, f"segment:{g}", F.col(g), ["n", "rmsle", "bias", "share_of_error", "lift"]))
    for f in features:
        curve = bias_curve(work, f, bins, min_n)
        out = out.unionByName(melt(curve, f"bias:{f}", F.col("bin"), ["n", "feature_mean", "rmsle", "bias"]))
    if ids:
        key = F.concat_ws("|", *[F.col(i).cast("string") for i in ids])
        out = out.unionByName(melt(worst_cases(work, ids, k), "worst", key, ["err", "abs_err"]))
    return out

