"""Sets of predictions compared with each other, row by row, without their truth.

Predictions are long: row keys, ``version`` and ``log_pred``. Rows are aligned by key, never by position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AlignmentError(AssertionError):
    """Two prediction sets do not cover the same rows."""


def aligned_wide(predictions: DataFrame, keys: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """One row per key with one column per version; the versions are a known list, so this is one aggregate."""
    picks = [F.max(F.when(F.col("version") == v, F.col("log_pred"))).alias(v) for v in versions]
    return predictions.where(F.col("version").isin(*versions)).groupBy(*keys).agg(*picks)


def check_alignment(wide: DataFrame, versions: Sequence[str]) -> DataFrame:
    """One row: total rows and rows some version lacks. Raise with ``assert_aligned``."""
    lacking = F.lit(False)
    for v in versions:
        lacking = lacking | F.col(v).isNull()
    return wide.agg(F.count("*").alias("rows"), F.count(F.when(lacking, 1)).alias("unmatched"))


def assert_aligned(wide: DataFrame, versions: Sequence[str]) -> DataFrame:
    found = check_alignment(wide, versions).first()
    if found["unmatched"]:
        raise AlignmentError(f"{found['unmatched']} of {found['rows']} rows are not in every prediction set")
    return wide


def prediction_gram(wide: DataFrame, scores: Mapping[str, float]) -> DataFrame:
    """For every ordered pair of versions: mean squared difference and the implied inner product of errors.

    With known scores s the inner product is (s_i^2 + s_j^2 - D_ij) / 2. All pairs come from one scan; the
    number of versions is a short parameter list.
    """
    names = list(scores)
    diffs = {(a, b): F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) for a, b in combinations(names, 2)}
    entries = []
    for a in names:
        for b in names:
            d = F.lit(0.0) if a == b else diffs[(a, b) if (a, b) in diffs else (b, a)]
            g = (scores[a] ** 2 + scores[b] ** 2 - d) / 2
            entries.append(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), d.alias("d"), g.alias("g")))
    return wide.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*")


def prediction_diff_stats(wide: DataFrame, anchor: str, candidate: str) -> DataFrame:
    """What a candidate moves: rows, share, mean move, mean square, the all-zero case and the break-even."""
    a, c = F.col(anchor), F.col(candidate)
    d = c - a
    moved = d != 0
    n = F.count("*")
    square = F.sum(d * d) / n
    return wide.agg(
        F.count(F.when(moved, 1)).alias("rows_moved"),
        (F.count(F.when(moved, 1)) / n).alias("share_moved"),
        F.avg(F.when(moved, F.abs(d))).alias("mean_move"),
        square.alias("d"),
        (F.sum(F.when(moved, c * c - a * a).otherwise(0.0)) / n).alias("zero_case"),
        (square / 2).alias("break_even"),
    )


def recover_prior(base: Column, corrected: Column, alpha: float) -> Column:
    """Invert a log-space blend: the prior that was mixed in with weight alpha."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")
    return (corrected - (1.0 - alpha) * base) / alpha


def recover_prior_stats(wide: DataFrame, base: str, corrected: str, alpha: float, tolerance: float = 1e-12) -> DataFrame:
    """Over the rows a blend changed: mean squared distance to the prior, their share, distinct prior values."""
    changed = F.abs(F.col(base) - F.col(corrected)) > tolerance
    prior = recover_prior(F.col(base), F.col(corrected), alpha)
    d = F.col(base) - prior
    per_value = (
        wide.select(changed.alias("hit"), F.when(changed, F.round(prior, 9)).alias("cell"), (d * d).alias("sq"))
        .groupBy("hit", "cell")
        .agg(F.count("*").alias("n"), F.sum("sq").alias("sq"))
    )
    hit = F.col("hit")
    return per_value.agg(
        (F.sum(F.when(hit, F.col("sq"))) / F.sum(F.when(hit, F.col("n")))).alias("c"),
        (F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)) / F.sum("n")).alias("row_share"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_rows"),
        F.count(F.when(hit, 1)).alias("prior_cells"),
    )


def segment_inner_products(wide: DataFrame, base: str, others: Sequence[str], partitions: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """mean(d * 1[segment]) and the segment share, for each prediction difference and each partition."""
    entries = []
    for partition, cells in partitions.items():
        for cell, condition in cells.items():
            share = F.avg(condition.cast("double"))
            for other in others:
                product = F.avg(F.when(condition, F.col(other) - F.col(base)).otherwise(0.0))
                entries.append(
                    F.struct(
                        F.lit(partition).alias("partition"), F.lit(cell).alias("cell"), F.lit(other).alias("version"),
                        product.alias("inner"), share.alias("share"),
                    )
                )
    return wide.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*")
