"""Forecast error in log space: metrics, segments, acceptance gates, resampling.

Scored rows carry ``y`` and one or more prediction columns, both in log space, so the metric is the root
mean square of their difference. All row-sized work is one aggregate; verdicts work on its few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.capacity import hurdle_dampen
from panelyard.functions.weather import floor_zero

# Unseen share of the scored rows, gate thresholds and horizon bands in days.
UNSEEN_SHARE = 0.2216
MIN_GAIN = 0.005
MAX_SEGMENT_REGRESSION = 0.002
HORIZON_BANDS = ((1, 30), (31, 60), (61, 90), (91, 122))
MAX_WEIGHTED = 1.08


def squared(pred: str, y: str = "y") -> Column:
    d = F.col(pred) - F.col(y)
    return d * d


def rmsle(pred: str, y: str = "y", where: Column | None = None) -> Column:
    """Aggregate expression; both columns are already in log space."""
    e = squared(pred, y)
    return F.sqrt(F.avg(e if where is None else F.when(where, e)))


def mix(seen: Column, unseen: Column, plain: Column, unseen_share: float = UNSEEN_SHARE) -> Column:
    """Root of the share-weighted mean squares; the plain metric if a side is empty."""
    both = seen.isNotNull() & unseen.isNotNull()
    return F.when(both, F.sqrt((1 - unseen_share) * seen * seen + unseen_share * unseen * unseen)).otherwise(plain)


def weighted_rmsle(pred: str, y: str = "y", seen: str = "seen", unseen_share: float = UNSEEN_SHARE) -> Column:
    s = F.col(seen).cast("boolean")
    return mix(rmsle(pred, y, s), rmsle(pred, y, ~s), rmsle(pred, y), unseen_share)


def metrics(scored: DataFrame, preds: Sequence[str]) -> DataFrame:
    """One row per prediction column: rmsle, weighted rmsle, seen and unseen part, row count."""
    aggs = []
    s = F.col("seen").cast("boolean")
    for p in preds:
        aggs.append(
            F.struct(
                F.lit(p).alias("model"),
                rmsle(p).alias("rmsle"),
                weighted_rmsle(p).alias("weighted_rmsle"),
                rmsle(p, where=s).alias("seen_rmsle"),
                rmsle(p, where=~s).alias("unseen_rmsle"),
                F.count("*").alias("n"),
            )
        )
    return scored.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def oof_segments(scored: DataFrame, pred: str = "pred") -> DataFrame:
    """Long table (segment, value): all, seen, unseen, n, unseen_share, test_comp, horizon bands, folds.

    Rows collapse once to (fold, band, seen) sums of squares; every segment is a sum of those few cells.
    Needs y, seen, horizon and fold.
    """
    band = F.lit(None).cast("string")
    for low, high in HORIZON_BANDS:
        band = F.when(F.col("horizon").between(low, high), F.lit(f"h{low}_{high}")).otherwise(band)
    seen = F.col("seen").cast("boolean")
    cells = scored.groupBy(F.col("fold").cast("string").alias("fold"), band.alias("band"), seen.alias("seen")).agg(
        F.sum(squared(pred)).alias("sq"), F.count("*").alias("n")
    )
    kinds = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("seen"), F.lit("seen")).otherwise(F.lit("unseen")),
            F.col("band"),
            F.concat(F.lit("fold_"), F.col("fold")),
        )
    )
    parts = cells.select(F.explode(kinds).alias("segment"), "sq", "n").groupBy("segment").agg(
        F.sqrt(F.sum("sq") / F.sum("n")).alias("value")
    )
    sq_s, n_s = F.sum(F.when(F.col("seen"), F.col("sq"))), F.sum(F.when(F.col("seen"), F.col("n")))
    sq_u, n_u = F.sum(F.when(~F.col("seen"), F.col("sq"))), F.sum(F.when(~F.col("seen"), F.col("n")))
    n = F.sum("n")
    comp = F.sqrt((1 - UNSEEN_SHARE) * sq_s / n_s + UNSEEN_SHARE * sq_u / n_u)
    totals = cells.agg(
        F.array(
            F.struct(F.lit("n").alias("segment"), n.cast("double").alias("value")),
            F.struct(F.lit("unseen_share").alias("segment"), (F.coalesce(n_u, F.lit(0)) / n).alias("value")),
            F.struct(F.lit("test_comp").alias("segment"), comp.alias("value")),
        ).alias("t")
    )
    return parts.unionByName(totals.select(F.explode("t").alias("t")).select("t.*"))


def acceptance_gate(
    base: DataFrame,
    candidate: DataFrame,
    min_gain: float = MIN_GAIN,
    max_regression: float = MAX_SEGMENT_REGRESSION,
    all_folds: bool = True,
    all_horizons: bool = True,
    informative: Sequence[str] = (),
) -> DataFrame:
    """Verdict row from two segment tables: delta_test_comp, passes, reasons (sorted codes).

    Reason codes: gain, regress:<segment>, fold:<name>, no_informative_fold, horizon:<band>.
    """
    both = base.select("segment", F.col("value").alias("b")).join(
        candidate.select("segment", F.col("value").alias("c")), "segment"
    )
    # Twelve digits: the noise of two summation orders is neither a gain nor a regression.
    delta = F.round(F.col("c") - F.col("b"), 12)
    seg = F.col("segment")
    fold = seg.startswith("fold_")
    if informative:
        fold = fold & seg.isin([f"fold_{f}" for f in informative])
    band = seg.rlike(r"^h[0-9]")
    reason = F.when((seg == "test_comp") & (delta > -min_gain), F.lit("gain")).when(
        seg.isin("seen", "unseen") & (delta > max_regression), F.concat(F.lit("regress:"), seg)
    )
    if all_folds:
        reason = reason.when(fold & (delta > 0), F.concat(F.lit("fold:"), F.expr("substring(segment, 6)")))
    if all_horizons:
        reason = reason.when(band & (delta > 0), F.concat(F.lit("horizon:"), seg))
    # The segment table has a dozen rows by construction.
    found = both.withColumn("reason", reason).agg(
        F.max(F.when(seg == "test_comp", delta)).alias("delta_test_comp"),
        F.count(F.when(fold, 1)).alias("folds"),
        F.array_sort(F.collect_list("reason")).alias("reasons"),
    )
    missing = F.lit(all_folds) & (F.col("folds") == 0)
    reasons = F.when(missing, F.array_append("reasons", F.lit("no_informative_fold"))).otherwise(F.col("reasons"))
    return found.withColumn("reasons", reasons).select(
        "delta_test_comp", (F.size("reasons") == 0).alias("passes"), F.array_join("reasons", ",").alias("reasons")
    )


def paired_delta(scored: DataFrame, base: str = "pred_a", cand: str = "pred_b", weighted: bool = False) -> DataFrame:
    """Metric difference per seed, then its mean, standard error and whether it exceeds two of them."""
    metric = weighted_rmsle if weighted else rmsle
    per_seed = scored.groupBy("seed").agg((metric(cand) - metric(base)).alias("delta"))
    return per_seed.agg(
        F.avg("delta").alias("mean_delta"),
        (F.stddev_samp("delta") / F.sqrt(F.count("delta"))).alias("standard_error"),
        F.count("delta").alias("seeds"),
    ).withColumn(
        "is_significant",
        F.coalesce((F.col("seeds") > 1) & (F.abs("mean_delta") > 2 * F.col("standard_error")), F.lit(False)),
    )


def poisson_table(highest: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson(1) draw below ``highest``."""
    total, out = 0.0, []
    for k in range(highest):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


# Modulus and steps of the multipliers that turn an entity's hash into its uniform of a resample; the check
# query computes the same integers.
PRIME, STEP_TWO, STEP_ONE = 2147483647, 48271, 16807


def poisson_weights(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """(entities, resamples) Poisson(1) counts by inversion of hash x multiplier modulo a prime."""
    numbers = np.arange(1, resamples + 1, dtype=np.int64)
    multipliers = (STEP_TWO * numbers * numbers + STEP_ONE * numbers + 1) % PRIME
    uniform = (hashes[:, None] * multipliers[None, :]) % PRIME / PRIME
    return np.searchsorted(poisson_table(), uniform, "right")


def resample_sums(entities: DataFrame, parts: Sequence[str], resamples: int) -> DataFrame:
    """Per resample the weighted sums of ``parts``. Every batch of entities sends one row per resample, not one per draw."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in parts], axis=1)
            hashes = batch.column("h").to_numpy()
            sums = np.zeros((resamples, len(parts)))
            for low in range(0, len(hashes), 2000):
                sums += poisson_weights(hashes[low : low + 2000], resamples).T.astype(float) @ values[low : low + 2000]
            columns = [pa.array(np.arange(1, resamples + 1)), *[pa.array(sums[:, k]) for k in range(len(parts))]]
            yield pa.RecordBatch.from_arrays(columns, ["resample", *parts])

    schema = "resample long, " + ", ".join(f"{n} double" for n in parts)
    per_batch = entities.select("h", *parts).mapInArrow(scan, schema)
    return per_batch.groupBy("resample").agg(*[F.sum(n).alias(n) for n in parts])


def cluster_bootstrap(
    scored: DataFrame, base: str = "pred_a", cand: str = "pred_b", resamples: int = 400, seed: int = 42,
    unseen_share: float = UNSEEN_SHARE, weighted: bool = True,
) -> DataFrame:
    """95 % interval of the metric difference under resampling of entities.

    Each entity's squared errors collapse to six numbers. Every resample then weighs each entity by a
    Poisson(1) count drawn from a hash of (seed, entity) and the resample's multiplier: the distributed form of
    drawing entities with replacement. Weighted sums per resample are formed per batch of entities, so nothing is
    ever expanded to entities x resamples.
    """
    s = F.col("seen").cast("boolean")
    ea, eb = squared(base), squared(cand)
    parts = {
        "n_s": F.sum(s.cast("int")),
        "n_u": F.sum((~s).cast("int")),
        "a_s": F.sum(F.when(s, ea).otherwise(0.0)),
        "a_u": F.sum(F.when(~s, ea).otherwise(0.0)),
        "b_s": F.sum(F.when(s, eb).otherwise(0.0)),
        "b_u": F.sum(F.when(~s, eb).otherwise(0.0)),
    }
    entities = scored.groupBy("entity_id").agg(*[c.alias(n) for n, c in parts.items()])
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("entity_id").cast("string")).cast("binary"))
    hashed = entities.withColumn("h", F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"))
    sums = resample_sums(hashed, list(parts), resamples)

    def score(x: str) -> Column:
        plain = F.sqrt((F.col(f"{x}_s") + F.col(f"{x}_u")) / (F.col("n_s") + F.col("n_u")))
        seen = F.sqrt(F.try_divide(F.col(f"{x}_s"), F.col("n_s")))
        unseen = F.sqrt(F.try_divide(F.col(f"{x}_u"), F.col("n_u")))
        return mix(seen, unseen, plain, unseen_share) if weighted else plain

    per = sums.where("n_s + n_u > 0").select((score("b") - score("a")).alias("d"))
    return per.agg(
        F.avg("d").alias("mean"),
        F.percentile("d", F.lit(0.025)).alias("ci_lower"),
        F.percentile("d", F.lit(0.975)).alias("ci_upper"),
        F.count("*").alias("resamples"),
    ).withColumn("excludes_zero", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def promotion_verdict(scored: DataFrame, max_weighted: float = MAX_WEIGHTED, max_ci_upper: float = 0.0, resamples: int = 500) -> DataFrame:
    """Per-fold and pooled scores of raw and final predictions, with the verdict on the pooled row.

    Needs entity_id, y, seen, fold, pred_raw and pred_final.
    """
    s = F.col("seen").cast("boolean")
    aggs = [
        F.count("*").alias("rows"),
        rmsle("pred_raw").alias("raw_rmsle"),
        rmsle("pred_final").alias("final_rmsle"),
        weighted_rmsle("pred_final").alias("weighted_rmsle"),
        rmsle("pred_final", where=s).alias("seen_rmsle"),
        rmsle("pred_final", where=~s).alias("unseen_rmsle"),
    ]
    folds = scored.groupBy(F.col("fold").cast("string").alias("fold")).agg(*aggs)
    pooled = scored.agg(F.lit("pooled").alias("fold"), *aggs)
    upper = cluster_bootstrap(scored, "pred_raw", "pred_final", resamples).select("ci_upper").scalar()
    passed = (F.col("weighted_rmsle") < max_weighted) & (F.col("ci_upper") <= max_ci_upper)
    return (
        folds.unionByName(pooled)
        .withColumn("ci_upper", F.when(F.col("fold") == "pooled", upper))
        .withColumn("status", F.when(F.col("fold") == "pooled", F.when(passed, "PASSED").otherwise("REVIEW")))
    )


def evaluate_on_anomalies(scored: DataFrame, pred: str = "pred", y: str = "y", flag: str = "is_anomaly") -> DataFrame:
    a = F.col(flag)
    return scored.agg(
        rmsle(pred, y).alias("overall"), rmsle(pred, y, ~a).alias("normal"), rmsle(pred, y, a).alias("anomalies")
    )


def blend_weights(scored: DataFrame, first: str = "pred_a", second: str = "pred_b") -> DataFrame:
    """The convex pair of weights with the smallest squared error, in closed form from one pass.

    With errors e1 and e2 the loss is quadratic in the first weight, so its minimum is
    (S22 - S12) / (S11 - 2 S12 + S22), clipped to [0, 1].
    """
    e1, e2 = F.col(first) - F.col("y"), F.col(second) - F.col("y")
    sums = scored.agg(
        F.sum(e1 * e1).alias("s11"), F.sum(e1 * e2).alias("s12"), F.sum(e2 * e2).alias("s22"), F.count("*").alias("n")
    )
    raw = F.try_divide(F.col("s22") - F.col("s12"), F.col("s11") - 2 * F.col("s12") + F.col("s22"))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.5))))
    out = sums.withColumn("w_first", w).withColumn("w_second", 1 - F.col("w_first"))
    loss = (
        F.col("w_first") ** 2 * F.col("s11")
        + 2 * F.col("w_first") * F.col("w_second") * F.col("s12")
        + F.col("w_second") ** 2 * F.col("s22")
    )
    return out.select("w_first", "w_second", F.sqrt(loss / F.col("n")).alias("blend_rmsle"))


def ensemble_mean(predictions: DataFrame, weights: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Mean over seeds per model, then the weighted sum over models. Rows: keys, model, seed, pred.

    One aggregate: each model's mean is a conditional average, so no second shuffle is needed.
    """
    parts = [F.avg(F.when(F.col("model") == m, F.col("pred"))) * F.lit(float(w)) for m, w in weights.items()]
    return predictions.groupBy(*keys).agg(sum(parts[1:], parts[0]).alias("pred"))


def apply_hurdle(rows: DataFrame, pred: str = "pred", p_active: str = "p_active") -> DataFrame:
    return rows.withColumn(pred, hurdle_dampen(F.col(pred), F.col(p_active), F.col("seen").cast("boolean")))


def shift_segments(rows: DataFrame, shifts: DataFrame, keys: Sequence[str], pred: str = "pred") -> DataFrame:
    """Add a per-segment constant (column ``shift``) to the log prediction, never below zero."""
    out = rows.join(shifts, list(keys), "left")
    moved = floor_zero(F.col(pred) + F.coalesce("shift", F.lit(0.0)))
    return out.withColumn(pred, moved).drop("shift")


def fold_number(date: Column, folds: Sequence[tuple[str, str]]) -> Column:
    """Name of the fold window holding a date; folds are a short parameter list."""
    out = F.lit(None).cast("string")
    for start, end in folds:
        inside = (date >= F.to_date(F.lit(start))) & (date < F.to_date(F.lit(end)))
        out = F.when(inside, F.lit(start)).otherwise(out)
    return out


def monotonic(biases: Column) -> Column:
    """Whether an ordered array never falls or never rises, over at least three steps apart values."""
    steps = F.zip_with(F.slice(biases, 2, F.greatest(F.size(biases) - 1, F.lit(0))), biases, lambda b, a: b - a)
    steps = F.filter(steps, lambda d: d.isNotNull())
    rising = F.forall(steps, lambda d: d >= -1e-12)
    falling = F.forall(steps, lambda d: d <= 1e-12)
    return (F.size(steps) >= 2) & (rising | falling)


