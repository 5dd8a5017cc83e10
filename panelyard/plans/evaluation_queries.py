"""Scores, gates, explanations and comparisons of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.rounding import rounded
from panelyard.operators import evaluate as E
from panelyard.operators import explain as X
from panelyard.operators import predictions as P
from panelyard.plans import tables as T
from panelyard.plans.registry import cte, register

MODELS = ("pred_a", "pred_b", "pred_c")
SHARE = E.UNSEEN_SHARE


def rms(pred: str, where: str = "") -> str:
    return f"sqrt(avg(pow({pred} - y, 2)){' FILTER (WHERE ' + where + ')' if where else ''})"


def weighted(pred: str) -> str:
    return (
        f"coalesce(sqrt({1 - SHARE!r} * avg(pow({pred} - y, 2)) FILTER (WHERE seen) + {SHARE!r} * avg(pow({pred} - y, 2)) FILTER (WHERE NOT seen)), {rms(pred)})"
    )


@register(
    "rmsle",
    "model s, rmsle 6, seen_rmsle 6, unseen_rmsle 6, n i",
    " UNION ALL ".join(
        f"SELECT '{p}' AS model, {rms(p)} AS rmsle, {rms(p, 'seen')} AS seen_rmsle, {rms(p, 'NOT seen')} AS unseen_rmsle, count(*) AS n FROM scored" for p in MODELS
    ),
)
def rmsle(spark, d):
    return E.metrics(T.scored(spark, d), MODELS)


@register(
    "weighted_rmsle",
    "model s, weighted_rmsle 6",
    " UNION ALL ".join(f"SELECT '{p}' AS model, {weighted(p)} AS weighted_rmsle FROM scored" for p in MODELS),
)
def weighted_rmsle(spark, d):
    return E.metrics(T.scored(spark, d), MODELS)


def segments_sql(pred: str) -> str:
    bands = " ".join(
        f"UNION ALL SELECT 'h{a}_{b}', {rms(pred)} FROM scored WHERE horizon BETWEEN {a} AND {b} HAVING count(*) > 0" for a, b in E.HORIZON_BANDS
    )
    return f"""
SELECT 'all' AS segment, {rms(pred)} AS value FROM scored
UNION ALL SELECT 'seen', {rms(pred)} FROM scored WHERE seen HAVING count(*) > 0
UNION ALL SELECT 'unseen', {rms(pred)} FROM scored WHERE NOT seen HAVING count(*) > 0
{bands}
UNION ALL SELECT 'fold_' || fold, {rms(pred)} FROM scored GROUP BY fold
UNION ALL SELECT 'n', count(*) FROM scored
UNION ALL SELECT 'unseen_share', avg(CASE WHEN seen THEN 0e0 ELSE 1e0 END) FROM scored
UNION ALL SELECT 'test_comp', sqrt({1 - SHARE!r} * avg(pow({pred} - y, 2)) FILTER (WHERE seen) + {SHARE!r} * avg(pow({pred} - y, 2)) FILTER (WHERE NOT seen)) FROM scored"""


cte("segments_a", segments_sql("pred_a"))
cte("segments_c", segments_sql("pred_c"))


@register("oof_segments", "segment s, value 6", "SELECT * FROM segments_a")
def oof_segments(spark, d):
    return E.oof_segments(T.scored(spark, d), "pred_a")


@register(
    "acceptance_gate",
    "delta_test_comp 6, passes i, reasons s",
    f"""
SELECT max(CASE WHEN segment = 'test_comp' THEN delta END) AS delta_test_comp, count(reason) = 0 AS passes,
       coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons
FROM (SELECT *, CASE WHEN segment = 'test_comp' AND delta > -{E.MIN_GAIN} THEN 'gain'
                     WHEN segment IN ('seen', 'unseen') AND delta > {E.MAX_SEGMENT_REGRESSION} THEN 'regress:' || segment
                     WHEN segment LIKE 'fold_%' AND delta > 0 THEN 'fold:' || substr(segment, 6)
                     WHEN segment SIMILAR TO 'h[0-9].*' AND delta > 0 THEN 'horizon:' || segment END AS reason
      FROM (SELECT a.segment, round(c.value - a.value, 12) AS delta FROM segments_a a JOIN segments_c c ON c.segment = a.segment))""",
)
def acceptance_gate(spark, d):
    rows = T.scored(spark, d)
    return E.acceptance_gate(E.oof_segments(rows, "pred_a"), E.oof_segments(rows, "pred_c"))


# Three seeds: the same candidates with a seed-dependent offset.
cte(
    "seeded",
    "SELECT s.*, seed, pred_a + 0.01e0 * seed AS base, pred_c + 0.01e0 * seed + 0.002e0 * seed * seed AS cand FROM scored s, (SELECT unnest([1, 2, 3]) AS seed)",
)


@register(
    "paired_delta",
    "mean_delta 6, standard_error 6, seeds i, is_significant i",
    f"""
SELECT avg(delta) AS mean_delta, stddev_samp(delta) / sqrt(count(*)) AS standard_error, count(*) AS seeds,
       abs(avg(delta)) > 2 * stddev_samp(delta) / sqrt(count(*)) AS is_significant
FROM (SELECT seed, {weighted('cand')} - {weighted('base')} AS delta FROM seeded GROUP BY 1)""",
)
def paired_delta(spark, d):
    seed = F.col("seed")
    rows = T.scored(spark, d).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumns(
        {"base": F.col("pred_a") + 0.01 * seed, "cand": F.col("pred_c") + 0.01 * seed + 0.002 * seed * seed}
    )
    return E.paired_delta(rows, "base", "cand", weighted=True)


POISSON = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(E.poisson_table())) + " ELSE 12 END"


def resampled_sql(base: str, cand: str, resamples: int, seed: int = 42) -> str:
    """One row per resample with the metric difference d, from the same hash and multipliers."""
    score = "coalesce(sqrt({0!r} * {x}_s / nullif(n_s, 0) + {1!r} * {x}_u / nullif(n_u, 0)), sqrt(({x}_s + {x}_u) / (n_s + n_u)))"
    first, second = (score.format(1 - SHARE, SHARE, x=x) for x in ("a", "b"))
    sums = ", ".join(f"sum(w * {c}) AS {c}" for c in ("n_s", "n_u", "a_s", "a_u", "b_s", "b_u"))
    errors = ", ".join(
        f"coalesce(sum(pow({p} - y, 2)) FILTER (WHERE {f}), 0) AS {x}_{g}" for p, x in ((base, "a"), (cand, "b")) for f, g in (("seen", "s"), ("NOT seen", "u"))
    )
    return f"""
SELECT r, {second} - {first} AS d FROM (
  SELECT r, {sums} FROM (
    SELECT *, {POISSON} AS w FROM (
      SELECT e.*, r, (h * (({E.STEP_TWO} * r * r + {E.STEP_ONE} * r + 1) % {E.PRIME})) % {E.PRIME} / {E.PRIME}e0 AS u
      FROM (SELECT CAST('0x' || substr(md5('{seed}|' || entity_id), 1, 7) AS BIGINT) AS h, count(*) FILTER (WHERE seen) AS n_s, count(*) FILTER (WHERE NOT seen) AS n_u, {errors}
            FROM scored GROUP BY entity_id) e, (SELECT CAST(unnest(range(1, {resamples} + 1)) AS BIGINT) AS r))) GROUP BY r)
WHERE n_s + n_u > 0"""


@register(
    "cluster_bootstrap_ci",
    "mean 6, ci_lower 6, ci_upper 6, resamples i, excludes_zero i",
    f"""
SELECT avg(d) AS mean, quantile_cont(d, 0.025) AS ci_lower, quantile_cont(d, 0.975) AS ci_upper, count(*) AS resamples,
       quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero
FROM ({resampled_sql('pred_a', 'pred_c', 400)})""",
)
def cluster_bootstrap_ci(spark, d):
    return E.cluster_bootstrap(T.scored(spark, d), "pred_a", "pred_c")


VERDICT_COLUMNS = f"count(*) AS rows, {rms('pred_b')} AS raw_rmsle, {rms('pred_a')} AS final_rmsle, {weighted('pred_a')} AS weighted_rmsle, {rms('pred_a', 'seen')} AS seen_rmsle, {rms('pred_a', 'NOT seen')} AS unseen_rmsle"


@register(
    "promotion_verdict",
    "fold s, rows i, raw_rmsle 6, final_rmsle 6, weighted_rmsle 6, seen_rmsle 6, unseen_rmsle 6, status s",
    f"""
SELECT fold, {VERDICT_COLUMNS}, NULL AS status FROM scored GROUP BY fold
UNION ALL
SELECT 'pooled', {VERDICT_COLUMNS},
       CASE WHEN {weighted('pred_a')} < {E.MAX_WEIGHTED} AND (SELECT quantile_cont(d, 0.975) FROM ({resampled_sql('pred_b', 'pred_a', 500)})) <= 0 THEN 'PASSED' ELSE 'REVIEW' END
FROM scored""",
)
def promotion_verdict(spark, d):
    rows = T.scored(spark, d).withColumns({"pred_raw": F.col("pred_b"), "pred_final": F.col("pred_a")})
    return E.promotion_verdict(rows)


cte("errors", "SELECT *, pred_a - y AS err, pow(pred_a - y, 2) AS sq_err, abs(pred_a - y) AS abs_err FROM scored")


def errors(spark, d):
    return X.add_error_columns(T.scored(spark, d), "y", "pred_a")


@register(
    "add_error_columns",
    "entity_id s, date d, err 6, sq_err 6, abs_err 6",
    "SELECT entity_id, date, err * sqrt(capacity) AS err, sq_err * capacity AS sq_err, abs_err * sqrt(capacity) AS abs_err FROM errors",
)
def add_error_columns(spark, d):
    return X.add_error_columns(T.scored(spark, d), "y", "pred_a", "capacity")


@register(
    "segment_report",
    "district s, n i, rmsle 6, bias 6, share_of_rows 6, share_of_error 6, lift 6",
    """
SELECT district, count(*) AS n, sqrt(avg(sq_err)) AS rmsle, avg(err) AS bias, count(*) / (SELECT count(*) FROM errors) AS share_of_rows,
       sum(sq_err) / (SELECT sum(sq_err) FROM errors) AS share_of_error,
       (sum(sq_err) / (SELECT sum(sq_err) FROM errors)) / (count(*) / (SELECT count(*) FROM errors)) AS lift
FROM errors GROUP BY 1 HAVING count(*) >= 20 ORDER BY share_of_error DESC, district LIMIT 20""",
)
def segment_report(spark, d):
    return X.segment_report(errors(spark, d), ["district"], min_n=20)


cte(
    "bins",
    """
SELECT e.*, greatest(len(list_filter(edges, lambda x: x < y)) - 1, 0) AS bin
FROM errors e, (SELECT list_sort(list_distinct(quantile_cont(y, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM errors)""",
)
cte(
    "curve",
    """
SELECT bin, count(*) AS n, avg(y) AS feature_mean, sqrt(avg(sq_err)) AS rmsle, avg(err) AS bias FROM bins GROUP BY 1 HAVING count(*) >= 10""",
)


@register(
    "bias_curve",
    "bin i, n i, feature_mean 6, rmsle 6, bias 6, monotonic_bias i",
    """
SELECT c.*, m.up OR m.down AS monotonic_bias
FROM curve c, (SELECT count(*) >= 2 AND min(step) >= -1e-12 AS up, count(*) >= 2 AND max(step) <= 1e-12 AS down
               FROM (SELECT bias - lag(bias) OVER (ORDER BY bin) AS step FROM curve) WHERE step IS NOT NULL) m""",
)
def bias_curve(spark, d):
    return X.bias_curve(errors(spark, d), "y", min_n=10)


@register(
    "worst_cases",
    "entity_id s, date d, err 6, abs_err 6, capacity 1",
    "SELECT entity_id, date, err, abs_err, capacity FROM errors ORDER BY abs_err DESC, entity_id, date LIMIT 25",
)
def worst_cases(spark, d):
    return X.worst_cases(errors(spark, d), ["entity_id", "date"], extra=["capacity"])


@register(
    "compare_predictions",
    "district s, n i, rmsle_base 6, rmsle_cand 6, delta 6, verdict s, overall_delta 6",
    f"""
SELECT *, rmsle_cand - rmsle_base AS delta,
       CASE WHEN rmsle_cand - rmsle_base <= -0.005 THEN 'improved' WHEN rmsle_cand - rmsle_base >= 0.005 THEN 'regressed' ELSE 'same' END AS verdict,
       (SELECT {rms('pred_c')} - {rms('pred_a')} FROM scored) AS overall_delta
FROM (SELECT district, count(*) AS n, {rms('pred_a')} AS rmsle_base, {rms('pred_c')} AS rmsle_cand FROM scored GROUP BY 1 HAVING count(*) >= 20)""",
)
def compare_predictions(spark, d):
    rows = T.scored(spark, d)
    base, cand = (rows.select("entity_id", "date", "district", "y", F.col(p).alias("pred")) for p in ("pred_a", "pred_c"))
    return X.compare_predictions(base, cand, ["entity_id", "date"], ["district"], min_n=20)


def melted(section: str, key: str, names: str, source: str) -> str:
    """SQL of one section of the report: its columns as rows."""
    pairs = ", ".join(f"('{n}', CAST({n} AS DOUBLE))" for n in names.split())
    return f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, v.metric, v.value FROM ({source}) r, LATERAL (VALUES {pairs}) v(metric, value)"


def segments_sql(by: str, top: int = 15) -> str:
    share = "sum(sq_err) / (SELECT sum(sq_err) FROM errors)"
    return (
        f"SELECT {by}, count(*) AS n, sqrt(avg(sq_err)) AS rmsle, avg(err) AS bias, {share} AS share_of_error, "
        f"({share}) / (count(*) / (SELECT count(*) FROM errors)) AS lift FROM errors GROUP BY 1 HAVING count(*) >= 20 ORDER BY share_of_error DESC, {by} LIMIT {top}"
    )


def curve_sql(feature: str) -> str:
    edges = f"(SELECT list_sort(list_distinct(quantile_cont(CAST({feature} AS DOUBLE), [{', '.join(str(k / 10) for k in range(11))}]))) AS edges FROM errors)"
    return (
        f"SELECT bin, count(*) AS n, avg({feature}) AS feature_mean, sqrt(avg(sq_err)) AS rmsle, avg(err) AS bias FROM ("
        f"SELECT e.*, greatest(len(list_filter(edges, lambda x: x < {feature})) - 1, 0) AS bin FROM errors e, {edges}) GROUP BY 1 HAVING count(*) >= 20"
    )


REPORT_SQL = " UNION ALL ".join(
    [
        melted("overall", "'all'", "n rmsle bias", "SELECT count(*) AS n, sqrt(avg(sq_err)) AS rmsle, avg(err) AS bias FROM errors"),
        *[melted(f"segment:{by}", by, "n rmsle bias share_of_error lift", segments_sql(by)) for by in ("district", "province")],
        *[melted(f"bias:{f}", "bin", "n feature_mean rmsle bias", curve_sql(f)) for f in ("y", "horizon")],
        melted("worst", "entity_id || '|' || CAST(date AS VARCHAR)", "err abs_err", "SELECT * FROM errors ORDER BY abs_err DESC, entity_id, date LIMIT 20"),
    ]
)


@register("error_report", "section s, key s, metric s, value 6", REPORT_SQL)
def error_report(spark, d):
    return X.error_report(T.scored(spark, d), ["district", "province"], ["y", "horizon"], ["entity_id", "date"], "y", "pred_a", min_n=20)


KNOWN = {"v1": 1.10, "v2": 1.12, "v3": 1.08}
SCORES = ", ".join(f"('{k}', {v}e0)" for k, v in KNOWN.items())


def wide(spark, d):
    rows = P.aligned_wide(T.forecasts(spark, d), ["entity_id", "date"], T.VERSIONS)
    return P.assert_aligned(rows, T.VERSIONS)


@register(
    "prediction_file_diff",
    "rows i, unmatched i",
    """
SELECT count(*) AS rows, count(*) FILTER (WHERE n < 3) AS unmatched
FROM (SELECT entity_id, date, count(DISTINCT version) AS n FROM forecasts WHERE NOT (version = 'v2' AND day(date) = 1) GROUP BY 1, 2)""",
)
def prediction_file_diff(spark, d):
    rows = T.forecasts(spark, d).where(~((F.col("version") == "v2") & (F.dayofmonth("date") == 1)))
    return P.check_alignment(P.aligned_wide(rows, ["entity_id", "date"], T.VERSIONS), T.VERSIONS)


@register(
    "prediction_gram",
    "i s, j s, d 6, g 6",
    f"""
SELECT a.version AS i, b.version AS j, avg(pow(a.log_pred - b.log_pred, 2)) AS d,
       (pow(any_value(s.score), 2) + pow(any_value(t.score), 2) - avg(pow(a.log_pred - b.log_pred, 2))) / 2 AS g
FROM forecasts a JOIN forecasts b ON b.entity_id = a.entity_id AND b.date = a.date
JOIN (VALUES {SCORES}) s(version, score) ON s.version = a.version JOIN (VALUES {SCORES}) t(version, score) ON t.version = b.version GROUP BY 1, 2""",
)
def prediction_gram(spark, d):
    return P.prediction_gram(wide(spark, d), KNOWN)


# Predictions as a file would hold them, to six digits, so that unmoved rows are exactly equal.
cte("filed", "SELECT round(pred_a + 1e-9, 6) AS a, round(pred_c + 1e-9, 6) AS c FROM scored")


@register(
    "prediction_diff_stats",
    "rows_moved i, share_moved 6, mean_move 6, d 6, zero_case 6, break_even 6",
    """
SELECT count(*) FILTER (WHERE c <> a) AS rows_moved, avg(CASE WHEN c <> a THEN 1e0 ELSE 0e0 END) AS share_moved,
       avg(abs(c - a)) FILTER (WHERE c <> a) AS mean_move, avg(pow(c - a, 2)) AS d, avg(pow(c, 2) - pow(a, 2)) AS zero_case,
       avg(pow(c - a, 2)) / 2 AS break_even FROM filed""",
)
def prediction_diff_stats(spark, d):
    rows = wide(spark, d)
    return P.prediction_diff_stats(rows.withColumns({v: rounded(v, 6) for v in T.VERSIONS}), "v1", "v3")


@register(
    "recover_prior_stats",
    "c 6, row_share 6, n_rows i, prior_cells i",
    """
SELECT avg(pow(pred_a - prior, 2)) FILTER (WHERE hit) AS c, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS row_share, count(*) FILTER (WHERE hit) AS n_rows,
       count(DISTINCT round(prior, 7)) FILTER (WHERE hit) AS prior_cells
FROM (SELECT pred_a, capacity / 100 AS prior, NOT seen AND abs(capacity / 100 - pred_a) > 1e-9 AS hit FROM scored)""",
)
def recover_prior_stats(spark, d):
    # New meters get a capacity-based prior mixed in at 0.6; the operator finds it again.
    mixed = F.when(F.col("seen"), F.col("pred_a")).otherwise(0.4 * F.col("pred_a") + 0.6 * F.col("capacity") / 100)
    rows = T.scored(spark, d).select(F.col("pred_a").alias("base"), mixed.alias("corrected"))
    return P.recover_prior_stats(rows, "base", "corrected", 0.6)


@register(
    "segment_inner_products",
    "partition s, cell s, version s, inner_product 6, share 6",
    """
SELECT p.partition, p.cell, v.version, avg(CASE WHEN p.hit THEN v.d ELSE 0 END) AS inner_product, avg(CASE WHEN p.hit THEN 1e0 ELSE 0e0 END) AS share
FROM scored s, LATERAL (VALUES ('global', 'all', TRUE), ('seen', 'seen', s.seen), ('seen', 'unseen', NOT s.seen), ('month', 'm4', month(s.date) = 4),
     ('month', 'm5', month(s.date) = 5), ('month', 'm6', month(s.date) = 6), ('month', 'm7', month(s.date) = 7)) p(partition, cell, hit),
     LATERAL (VALUES ('v2', s.pred_b - s.pred_a), ('v3', s.pred_c - s.pred_a)) v(version, d) GROUP BY 1, 2, 3""",
)
def segment_inner_products(spark, d):
    rows = T.scored(spark, d).withColumnsRenamed({"pred_a": "v1", "pred_b": "v2", "pred_c": "v3"})
    seen, month = F.col("seen"), F.month("date")
    parts = {"global": {"all": F.lit(True)}, "seen": {"seen": seen, "unseen": ~seen}, "month": {f"m{k}": month == k for k in (4, 5, 6, 7)}}
    return P.segment_inner_products(rows, "v1", ["v2", "v3"], parts).withColumnRenamed("inner", "inner_product")


@register(
    "blend_weights",
    "w_first 6, w_second 6, blend_rmsle 6",
    """
SELECT w AS w_first, 1 - w AS w_second, sqrt(avg(pow(w * pred_b + (1 - w) * pred_c - y, 2))) AS blend_rmsle
FROM scored, (SELECT greatest(0, least(1, sum((y - pred_c) * (pred_b - pred_c)) / sum(pow(pred_b - pred_c, 2)))) AS w FROM scored)
GROUP BY w""",
)
def blend_weights(spark, d):
    return E.blend_weights(T.scored(spark, d), "pred_b", "pred_c")


@register(
    "ensemble_mean",
    "entity_id s, date d, pred 6",
    """
SELECT entity_id, date, 0.44e0 * (pred_a + (pred_a + 0.1)) / 2 + 0.56e0 * (pred_c + (pred_c - 0.3)) / 2 AS pred FROM scored""",
)
def ensemble_mean(spark, d):
    def member(model: str, seed: int, value):
        return F.struct(F.lit(model).alias("model"), F.lit(seed).alias("seed"), value.alias("pred"))

    a, c = F.col("pred_a"), F.col("pred_c")
    members = F.array(member("first", 1, a), member("first", 2, a + 0.1), member("second", 1, c), member("second", 2, c - 0.3))
    rows = T.scored(spark, d).select("entity_id", "date", F.explode(members).alias("m")).select("entity_id", "date", "m.*")
    return E.ensemble_mean(rows, {"first": 0.44, "second": 0.56}, ["entity_id", "date"])
