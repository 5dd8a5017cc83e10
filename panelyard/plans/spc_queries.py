"""Control charts over user x hour series."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import evaluate as E
from panelyard.operators import spc as S
from panelyard.plans import tables as T
from panelyard.plans.registry import cte, register
from panelyard.session import staged

KEYS, ORDER = ["user_id"], "hour"

cte(
    "detrended",
    """
SELECT user_id, hour, value, ln(1 + value) - coalesce(ahead, behind, own) AS resid
FROM (SELECT *, first_value(trend IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
             last_value(trend IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS behind,
             avg(ln(1 + value)) OVER (PARTITION BY user_id) AS own
      FROM (SELECT *, CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(ln(1 + value), 0.5) OVER w END AS trend FROM hourly WHERE value > 0
            WINDOW w AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)))""",
)
cte(
    "baselines",
    """
SELECT user_id, avg(resid) AS baseline_mean, greatest(coalesce(stddev_samp(resid), 0), 1e-6) AS baseline_std, count(*) AS baseline_n
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hour) AS rn, count(*) OVER (PARTITION BY user_id) AS n,
             stddev_samp(value) OVER (PARTITION BY user_id) AS raw FROM detrended)
WHERE rn <= greatest(30, floor(n * 0.5)) AND raw <> 0 GROUP BY 1 HAVING count(*) >= 30""",
)
cte(
    "charted",
    """
SELECT d.*, b.baseline_mean AS m, b.baseline_std AS s, (d.resid - b.baseline_mean) / b.baseline_std AS z,
       row_number() OVER (PARTITION BY d.user_id ORDER BY d.hour) AS rn
FROM detrended d JOIN baselines b ON b.user_id = d.user_id""",
)


def detrended(spark, d):
    return S.centered_median_detrend(S.valid_for_spc(T.hourly(spark, d), "user_id"), KEYS, ORDER, "value")


def fitted(spark, d):
    """(rows with residual, baselines), the rows stored because both the fit and the charts read them."""
    rows = staged(detrended(spark, d))
    return rows, S.spc_baseline_split(rows, KEYS, ORDER, "resid", "value")


def charted(spark, d):
    rows, base = fitted(spark, d)
    return rows.join(base, KEYS)


@register("centered_median_detrend", "user_id i, hour s, resid 6", "SELECT user_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, resid FROM detrended")
def centered_median_detrend(spark, d):
    return detrended(spark, d)


@register(
    "spc_fit",
    "user_id i, baseline_mean 6, baseline_std 6, baseline_n i",
    "SELECT user_id, avg(value) AS baseline_mean, stddev_samp(value) AS baseline_std, count(value) AS baseline_n FROM hourly GROUP BY 1",
)
def spc_fit(spark, d):
    return S.spc_fit(T.hourly(spark, d), KEYS, "value")


@register("spc_baseline_split", "user_id i, baseline_mean 6, baseline_std 6, baseline_n i", "SELECT * FROM baselines")
def spc_baseline_split(spark, d):
    return fitted(spark, d)[1]


cte(
    "shewhart_rows",
    """
SELECT user_id, hour, resid, m + 3 * mr / 1.128 AS shewhart_upper, m - 3 * mr / 1.128 AS shewhart_lower, abs(resid - m) > 3 * mr / 1.128 AS shewhart_anomaly
FROM (SELECT *, avg(step) OVER (PARTITION BY user_id) AS mr
      FROM (SELECT *, abs(resid - lag(resid) OVER (PARTITION BY user_id ORDER BY hour)) AS step FROM charted))""",
)
HOUR = "strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour"


@register(
    "shewhart",
    "user_id i, hour s, shewhart_upper 6, shewhart_lower 6, shewhart_anomaly i",
    f"SELECT * REPLACE ({HOUR}) FROM shewhart_rows",
)
def shewhart(spark, d):
    return S.shewhart(charted(spark, d), KEYS, ORDER, "resid")


cte(
    "ewma_path",
    """
SELECT user_id, rn, hour, m, s, resid AS e FROM charted WHERE rn = 1
UNION ALL
SELECT c.user_id, c.rn, c.hour, c.m, c.s, 0.2e0 * c.resid + 0.8e0 * p.e FROM ewma_path p JOIN charted c ON c.user_id = p.user_id AND c.rn = p.rn + 1""",
)
cte(
    "ewma_rows",
    """
SELECT user_id, hour, e AS ewma, m + reach AS ewma_upper, m - reach AS ewma_lower, abs(e - m) > reach AS ewma_anomaly
FROM (SELECT *, 2.66e0 * s * sqrt(0.2e0 / 1.8e0 * (1 - pow(0.8e0, 2 * rn))) AS reach FROM ewma_path)""",
)


@register(
    "ewma",
    "user_id i, hour s, ewma 6, ewma_upper 6, ewma_lower 6, ewma_anomaly i",
    f"SELECT * REPLACE ({HOUR}) FROM ewma_rows",
    recursive=True,
)
def ewma(spark, d):
    return S.ewma(charted(spark, d), KEYS, ORDER, "resid")


cte(
    "cusum_path",
    """
SELECT user_id, rn, hour, s, pos, neg, CASE WHEN pos > 4.77e0 * s OR neg < -4.77e0 * s THEN 0 ELSE pos END AS up,
       CASE WHEN pos > 4.77e0 * s OR neg < -4.77e0 * s THEN 0 ELSE neg END AS down
FROM (SELECT *, greatest(0, z - 0.5e0 * s) AS pos, least(0, z + 0.5e0 * s) AS neg FROM charted WHERE rn = 1)
UNION ALL
SELECT user_id, rn, hour, s, pos, neg, CASE WHEN pos > 4.77e0 * s OR neg < -4.77e0 * s THEN 0 ELSE pos END,
       CASE WHEN pos > 4.77e0 * s OR neg < -4.77e0 * s THEN 0 ELSE neg END
FROM (SELECT c.user_id, c.rn, c.hour, c.s, greatest(0, p.up + c.z - 0.5e0 * c.s) AS pos, least(0, p.down + c.z + 0.5e0 * c.s) AS neg
      FROM cusum_path p JOIN charted c ON c.user_id = p.user_id AND c.rn = p.rn + 1)""",
)
cte("cusum_rows", "SELECT user_id, hour, pos - neg AS cusum, 4.77e0 * s AS cusum_limit, pos - neg > 4.77e0 * s AS cusum_anomaly FROM cusum_path")
cte(
    "cusum_plain",
    """
SELECT user_id, rn, hour, pos, neg, CASE WHEN pos > 4.77e0 OR neg < -4.77e0 THEN 0 ELSE pos END AS up,
       CASE WHEN pos > 4.77e0 OR neg < -4.77e0 THEN 0 ELSE neg END AS down
FROM (SELECT *, greatest(0, z - 0.5e0) AS pos, least(0, z + 0.5e0) AS neg FROM charted WHERE rn = 1)
UNION ALL
SELECT user_id, rn, hour, pos, neg, CASE WHEN pos > 4.77e0 OR neg < -4.77e0 THEN 0 ELSE pos END,
       CASE WHEN pos > 4.77e0 OR neg < -4.77e0 THEN 0 ELSE neg END
FROM (SELECT c.user_id, c.rn, c.hour, greatest(0, p.up + c.z - 0.5e0) AS pos, least(0, p.down + c.z + 0.5e0) AS neg
      FROM cusum_plain p JOIN charted c ON c.user_id = p.user_id AND c.rn = p.rn + 1)""",
)


@register("cusum", "user_id i, hour s, cusum 6, cusum_limit 6, cusum_anomaly i", f"SELECT * REPLACE ({HOUR}) FROM cusum_rows", recursive=True)
def cusum(spark, d):
    return S.cusum(charted(spark, d), KEYS, ORDER, "resid")


@register(
    "cusum_standard",
    "user_id i, hour s, cusum 6, cusum_anomaly i",
    f"SELECT user_id, {HOUR}, pos - neg AS cusum, pos - neg > 4.77e0 AS cusum_anomaly FROM cusum_plain",
    recursive=True,
)
def cusum_standard(spark, d):
    return S.cusum(charted(spark, d), KEYS, ORDER, "resid", S.SPCConfig(cusum_units="standard"))


def windowed_rule(rows: int, condition: str) -> str:
    """Rows inside some full window of ``rows`` rows that meets a condition, by joining rows to windows."""
    return f"""
SELECT DISTINCT c.user_id, c.rn FROM charted c JOIN (
  SELECT a.user_id, a.rn AS start FROM charted a JOIN charted b ON b.user_id = a.user_id AND b.rn BETWEEN a.rn AND a.rn + {rows - 1}
  GROUP BY a.user_id, a.rn HAVING count(*) = {rows} AND ({condition})) w
ON w.user_id = c.user_id AND c.rn BETWEEN w.start AND w.start + {rows - 1}"""


cte("rule2", windowed_rule(9, "min(b.z) > 0 OR max(b.z) < 0"))
cte(
    "rule3",
    """
SELECT DISTINCT c.user_id, c.rn FROM charted c JOIN (
  SELECT user_id, rn AS last FROM (SELECT user_id, rn, min(dz) OVER w AS lo, max(dz) OVER w AS hi, count(dz) OVER w AS n
    FROM (SELECT *, z - lag(z) OVER (PARTITION BY user_id ORDER BY rn) AS dz FROM charted)
    WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS 4 PRECEDING)) WHERE n = 5 AND (lo > 0 OR hi < 0)) w
ON w.user_id = c.user_id AND c.rn BETWEEN w.last - 5 AND w.last""",
)
cte("rule5", windowed_rule(3, "count(*) FILTER (WHERE b.z > 2) >= 2 OR count(*) FILTER (WHERE b.z < -2) >= 2"))
cte("rule6", windowed_rule(5, "count(*) FILTER (WHERE b.z > 1) >= 4 OR count(*) FILTER (WHERE b.z < -1) >= 4"))
cte(
    "nelson_rows",
    """
SELECT user_id, hour, abs(z) > 3 AS nelson_r1, r2.rn IS NOT NULL AS nelson_r2, r3.rn IS NOT NULL AS nelson_r3,
       r5.rn IS NOT NULL AS nelson_r5, r6.rn IS NOT NULL AS nelson_r6,
       abs(z) > 3 OR coalesce(r2.rn, r3.rn, r5.rn, r6.rn) IS NOT NULL AS nelson_anomaly
FROM charted c LEFT JOIN rule2 r2 USING (user_id, rn) LEFT JOIN rule3 r3 USING (user_id, rn) LEFT JOIN rule5 r5 USING (user_id, rn)
LEFT JOIN rule6 r6 USING (user_id, rn)""",
)


@register(
    "nelson_rules",
    "user_id i, hour s, nelson_r1 i, nelson_r2 i, nelson_r3 i, nelson_r5 i, nelson_r6 i, nelson_anomaly i",
    f"SELECT * REPLACE ({HOUR}) FROM nelson_rows",
)
def nelson_rules(spark, d):
    return S.nelson_rules(charted(spark, d), KEYS, ORDER, "resid")


cte(
    "verdicts",
    """
SELECT user_id, hour, CAST(shewhart_anomaly AS INTEGER) AS s, CAST(ewma_anomaly AS INTEGER) AS e, CAST(cusum_anomaly AS INTEGER) AS c,
       CAST(nelson_anomaly AS INTEGER) AS n
FROM shewhart_rows JOIN ewma_rows USING (user_id, hour) JOIN cusum_rows USING (user_id, hour) JOIN nelson_rows USING (user_id, hour)""",
)
cte("counted", "SELECT *, s + e + c + n AS flagged FROM verdicts")


def detect(spark, d, aggregate="any"):
    return S.spc_detect(charted(spark, d), KEYS, ORDER, "resid", aggregate=aggregate)


def multi(spark, d):
    rows, base = fitted(spark, d)
    return S.spc_detect_multi(rows, base, KEYS, ORDER, "resid")


@register(
    "spc_detect",
    "user_id i, hour s, shewhart_anomaly i, ewma_anomaly i, cusum_anomaly i, nelson_anomaly i, n_methods_flagged i, is_anomaly i",
    f"""
SELECT user_id, {HOUR}, s AS shewhart_anomaly, e AS ewma_anomaly, c AS cusum_anomaly, n AS nelson_anomaly, flagged AS n_methods_flagged,
       flagged > 0 AS is_anomaly FROM counted""",
    recursive=True,
)
def spc_detect(spark, d):
    return detect(spark, d)


@register(
    "spc_detect_all",
    "user_id i, hour s, is_anomaly i",
    f"SELECT user_id, {HOUR}, flagged = 4 AS is_anomaly FROM counted",
    recursive=True,
)
def spc_detect_all(spark, d):
    return detect(spark, d, "all")


cte(
    "multi_rows",
    """
SELECT d.user_id, d.hour, d.resid, coalesce(c.flagged, 0) AS n_methods_flagged, coalesce(c.flagged >= 3, FALSE) AS is_anomaly
FROM detrended d LEFT JOIN counted c ON c.user_id = d.user_id AND c.hour = d.hour""",
)


@register(
    "spc_detect_multi",
    "user_id i, hour s, n_methods_flagged i, is_anomaly i",
    f"SELECT * REPLACE ({HOUR}) FROM multi_rows",
    recursive=True,
)
def spc_detect_multi(spark, d):
    return multi(spark, d)


@register(
    "spc_summary",
    "user_id i, anomaly_count i, anomaly_rate 4, avg_methods_flagged 4, max_methods_flagged i",
    """
SELECT user_id, count(*) FILTER (WHERE is_anomaly) AS anomaly_count, avg(CAST(is_anomaly AS INTEGER)) AS anomaly_rate,
       avg(n_methods_flagged) AS avg_methods_flagged, max(n_methods_flagged) AS max_methods_flagged FROM multi_rows GROUP BY 1""",
    recursive=True,
)
def spc_summary(spark, d):
    return S.spc_summary(multi(spark, d), KEYS)


@register(
    "spc_top_report",
    "user_id i, hour s, n_methods_flagged i",
    f"SELECT user_id, {HOUR}, n_methods_flagged FROM multi_rows WHERE is_anomaly ORDER BY n_methods_flagged DESC, user_id, multi_rows.hour LIMIT 100",
    recursive=True,
)
def spc_top_report(spark, d):
    return S.spc_top_report(multi(spark, d), KEYS, ORDER)


cte(
    "since",
    """
SELECT v.*, h.resid, h.m, h.sd, h.rn, max(CASE WHEN flagged > 0 THEN h.rn END) OVER (PARTITION BY v.user_id ORDER BY h.rn) AS last_hit,
       count(*) OVER w AS full_n, sum(CAST(flagged > 0 AS INTEGER)) OVER w AS density
FROM counted v JOIN (SELECT user_id, hour, resid, m, s AS sd, rn FROM charted) h ON h.user_id = v.user_id AND h.hour = v.hour
WINDOW w AS (PARTITION BY v.user_id ORDER BY h.rn ROWS 6 PRECEDING)""",
)


@register(
    "rolling_anomaly_density",
    "user_id i, hour s, anomaly_density 0",
    f"SELECT user_id, {HOUR}, CASE WHEN full_n = 7 THEN density END AS anomaly_density FROM since",
    recursive=True,
)
def rolling_anomaly_density(spark, d):
    return S.rolling_anomaly_density(detect(spark, d), KEYS, ORDER)


@register(
    "days_since_anomaly",
    "user_id i, hour s, days_since_anomaly 0",
    f"SELECT user_id, {HOUR}, coalesce(CAST(rn - last_hit AS DOUBLE), CAST('Infinity' AS DOUBLE)) AS days_since_anomaly FROM since",
    recursive=True,
)
def days_since_anomaly(spark, d):
    return S.days_since_anomaly(detect(spark, d), KEYS, ORDER)


@register(
    "spc_features",
    "user_id i, hour s, anomaly_score i, z_score 6, distance_from_center 6, is_anomaly i, days_since_anomaly 0, anomaly_density 0, ewma_trend 6, deviation_from_ewma 6",
    f"""
SELECT user_id, {HOUR}, flagged AS anomaly_score, (resid - m) / sd AS z_score, abs((resid - m) / sd) AS distance_from_center, flagged > 0 AS is_anomaly,
       coalesce(CAST(rn - last_hit AS DOUBLE), CAST('Infinity' AS DOUBLE)) AS days_since_anomaly, CASE WHEN full_n = 7 THEN density END AS anomaly_density,
       ewma AS ewma_trend, resid - ewma AS deviation_from_ewma
FROM since JOIN (SELECT user_id AS u, hour AS h, ewma FROM ewma_rows) ON u = user_id AND h = since.hour""",
    recursive=True,
)
def spc_features(spark, d):
    return S.spc_features(charted(spark, d), KEYS, ORDER, "resid")


@register(
    "spc_segments",
    "user_id i, hour s, segment s",
    f"""
SELECT user_id, {HOUR}, segment FROM (
  SELECT user_id, hour, 'normal' AS segment FROM counted WHERE flagged = 0
  UNION ALL SELECT user_id, hour, 'shewhart_only' FROM counted WHERE s = 1 AND e = 0 AND c = 0
  UNION ALL SELECT user_id, hour, 'ewma_only' FROM counted WHERE e = 1 AND s = 0
  UNION ALL SELECT user_id, hour, 'cusum_only' FROM counted WHERE c = 1 AND s = 0
  UNION ALL SELECT user_id, hour, 'multiple_methods' FROM counted WHERE s + e + c >= 2) x""",
    recursive=True,
)
def spc_segments(spark, d):
    return S.spc_segments(detect(spark, d))


@register(
    "anomaly_strategy_remove",
    "user_id i, hour s, resid 6",
    f"SELECT user_id, {HOUR}, resid FROM since WHERE flagged = 0",
    recursive=True,
)
def anomaly_strategy_remove(spark, d):
    return S.apply_anomaly_strategy(charted(spark, d), KEYS, ORDER, "resid", "remove")


@register(
    "anomaly_strategy_clip",
    "user_id i, hour s, resid 6",
    f"SELECT user_id, {HOUR}, greatest(shewhart_lower, least(shewhart_upper, resid)) AS resid FROM shewhart_rows",
)
def anomaly_strategy_clip(spark, d):
    return S.apply_anomaly_strategy(charted(spark, d), KEYS, ORDER, "resid", "clip")


@register(
    "anomaly_strategy_flag",
    "user_id i, hour s, resid 6, is_anomaly i",
    f"SELECT user_id, {HOUR}, resid, flagged > 0 AS is_anomaly FROM since",
    recursive=True,
)
def anomaly_strategy_flag(spark, d):
    return S.apply_anomaly_strategy(charted(spark, d), KEYS, ORDER, "resid", "flag")


@register(
    "stratified_split",
    "is_test i, rows i, anomaly_rate_pct 4",
    """
SELECT is_test, count(*) AS rows, avg(CASE WHEN is_anomaly THEN 100e0 ELSE 0e0 END) AS anomaly_rate_pct FROM (
  SELECT is_anomaly, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('42|' || CAST(user_id AS VARCHAR) || '|' || strftime(hour, '%Y-%m-%d %H:%M:%S')))
         <= round(count(*) OVER (PARTITION BY is_anomaly) * 0.2) AS is_test FROM multi_rows) GROUP BY 1""",
    recursive=True,
)
def stratified_split(spark, d):
    return S.split_report(S.stratified_split(staged(multi(spark, d)), ["user_id", "hour"]))


@register(
    "evaluate_on_anomalies",
    "overall 6, normal 6, anomalies 6",
    """
SELECT sqrt(avg(pow(resid, 2))) AS overall, sqrt(avg(pow(resid, 2)) FILTER (WHERE NOT is_anomaly)) AS normal,
       sqrt(avg(pow(resid, 2)) FILTER (WHERE is_anomaly)) AS anomalies FROM multi_rows""",
    recursive=True,
)
def evaluate_on_anomalies(spark, d):
    rows = multi(spark, d).withColumns({"y": F.lit(0.0), "pred": F.col("resid")})
    return E.evaluate_on_anomalies(rows)


# One path of the EWMA per preset: the smoothing differs.
for preset, config in S.PRESETS.items():
    lam = f"{config.ewma_lambda}e0"
    cte(
        f"path_{preset}",
        f"""
SELECT user_id, rn, m, s, resid AS e FROM charted WHERE rn = 1
UNION ALL SELECT c.user_id, c.rn, c.m, c.s, {lam} * c.resid + (1 - {lam}) * p.e FROM path_{preset} p JOIN charted c ON c.user_id = p.user_id AND c.rn = p.rn + 1""",
    )


def preset_sql(name: str) -> str:
    config = S.PRESETS[name]
    lam = f"{config.ewma_lambda}e0"
    reach = f"{config.ewma_multiplier}e0 * s * sqrt({lam} / (2 - {lam}) * (1 - pow(1 - {lam}, 2 * rn)))"
    return (
        f"SELECT '{name}' AS preset, (SELECT count(*) FROM charted) AS n, "
        f"(SELECT count(*) FROM shewhart_rows r JOIN (SELECT user_id AS u, any_value(m) AS m FROM charted GROUP BY 1) b ON b.u = r.user_id "
        f"WHERE abs(r.resid - b.m) > {config.shewhart_multiplier}e0 * (r.shewhart_upper - b.m) / 3) AS shewhart_flags, "
        f"(SELECT count(*) FROM path_{name} WHERE abs(e - m) > {reach}) AS ewma_flags"
    )


@register("presets", "preset s, n i, shewhart_flags i, ewma_flags i", " UNION ALL ".join(preset_sql(name) for name in S.PRESETS), recursive=True)
def presets(spark, d):
    """Rows that every sensitivity preset flags."""
    rows = staged(charted(spark, d))
    out = None
    for name, config in S.PRESETS.items():
        flagged = S.ewma(S.shewhart(rows, KEYS, ORDER, "resid", config), KEYS, ORDER, "resid", config)
        part = flagged.agg(
            F.lit(name).alias("preset"), F.count("*").alias("n"), F.count_if("shewhart_anomaly").alias("shewhart_flags"), F.count_if("ewma_anomaly").alias("ewma_flags")
        )
        out = part if out is None else out.unionByName(part)
    return out
