"""Change points. A x100 and a x1.8 level change are planted from fixed dates on part of the meters, with the same
expression in both engines. Detection runs over all meters and all days; states and repairs for a cutoff over what lies
before it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelyard.operators import features as FT
from panelyard.operators import history as H
from panelyard.operators import regime as R
from panelyard.operators.scale import latest_date, nearest_before
from panelyard.plans import tables as T
from panelyard.plans.history_queries import MATRIX, enriched, entity_history_sql, matrix_sql
from panelyard.plans.registry import CTES, cte, register
from panelyard.session import staged

PLANT = "CASE WHEN district_no % 3 = 0 AND date >= DATE '1997-06-01' THEN 100e0 WHEN district_no % 3 = 1 AND date >= DATE '1998-03-01' THEN 1.8e0 ELSE 1e0 END"
cte("planted", f"SELECT entity_id, date, capacity, round(value * {PLANT}, 2) AS value FROM train")


def planted(spark, d, whole=False):
    rows = (T.panel if whole else T.train)(spark, d).withColumn("value", F.round(F.col("value") * F.expr(PLANT), 2))
    return staged(rows.select("entity_id", "date", "capacity", "value"))


cte(
    "contrast",
    """
SELECT *, CASE WHEN pos >= 28 AND pos + 28 <= n THEN round(abs(r - l), 9) END AS contrast
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY entity_id) AS n,
             quantile_cont(ln(1 + value), 0.5) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS l,
             quantile_cont(ln(1 + value), 0.5) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) AS r FROM planted)""",
)


cte("split0", "SELECT *, 0 AS lo, n AS hi FROM contrast")
for step in (1, 2, 3, 4):
    cte(
        f"split{step}",
        f"""
SELECT * EXCLUDE (lo, hi, cut, best, ok), CASE WHEN pos >= cut THEN cut ELSE lo END AS lo, CASE WHEN pos < cut THEN cut ELSE hi END AS hi
FROM (SELECT *, min(CASE WHEN ok AND contrast = best THEN pos END) OVER (PARTITION BY entity_id, lo) AS cut
      FROM (SELECT *, max(CASE WHEN ok THEN contrast END) OVER (PARTITION BY entity_id, lo) AS best
            FROM (SELECT *, contrast >= 0.35 AND pos >= lo + 28 AND pos <= hi - 28 AND hi - lo >= 42 AND n >= 60 AS ok FROM split{step - 1})))""",
    )
cte("segmented", "SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY lo) - 1 AS seg FROM split4")
cte(
    "seg_stats",
    """
SELECT entity_id, seg, min(date) AS start, max(date) AS finish, count(*) AS n, coalesce(median(value) FILTER (WHERE value > 0), 0) AS level,
       avg(CASE WHEN value <= 0 THEN 1e0 ELSE 0e0 END) AS zero_frac, count(*) FILTER (WHERE value > 0) AS n_positive, any_value(capacity) AS capacity
FROM segmented GROUP BY 1, 2""",
)
cte(
    "seg_shape",
    """
SELECT entity_id, seg, isodow(date) AS dow, avg(ln(1 + value)) AS lvl FROM segmented WHERE value > 0 GROUP BY 1, 2, 3""",
)
RATES = ", ".join(str(r) for r in R.SCALE_RATES)
cte(
    "seg_kinds",
    f"""
SELECT a.*, CASE WHEN b.seg IS NULL THEN 'none' WHEN b.zero_frac >= 0.8 AND a.zero_frac < 0.8 THEN 'sleep'
    WHEN a.zero_frac >= 0.8 AND b.zero_frac < 0.8 THEN 'wake' WHEN a.n_positive < 5 OR b.n_positive < 5 THEN 'none'
    WHEN x.off < 0.18 AND x.size >= 2 AND date_diff('day', a.finish, b.start) <= 3
         AND ((coalesce(c.days, 0) >= 4 AND coalesce(c.r, -1) >= 0.55) OR greatest(a.level, b.level) > a.capacity * 24) THEN 'scale'
    ELSE 'step' END AS break_after, b.level / nullif(a.level, 0) AS raw_ratio
FROM seg_stats a LEFT JOIN seg_stats b ON b.entity_id = a.entity_id AND b.seg = a.seg + 1
LEFT JOIN (SELECT p.entity_id, p.seg, count(*) AS days, corr(p.lvl, q.lvl) AS r FROM seg_shape p
           JOIN seg_shape q ON q.entity_id = p.entity_id AND q.seg = p.seg + 1 AND q.dow = p.dow GROUP BY 1, 2) c ON c.entity_id = a.entity_id AND c.seg = a.seg,
LATERAL (SELECT greatest(b.level / nullif(a.level, 0), a.level / nullif(b.level, 0)) AS size,
                list_min([abs(CAST(r AS DOUBLE) - greatest(b.level / nullif(a.level, 0), a.level / nullif(b.level, 0))) / r for r in [{RATES}]]) AS off) x""",
)
cte(
    "seg_ratio",
    """
SELECT *, CASE break_after WHEN 'sleep' THEN 0 WHEN 'wake' THEN CAST('Infinity' AS DOUBLE) WHEN 'none' THEN 1 ELSE raw_ratio END AS ratio_after FROM seg_kinds""",
)
cte(
    "seg_factors",
    """
SELECT *, exp(sum(CASE WHEN break_after = 'scale' THEN ln(ratio_after) ELSE 0 END)
          OVER (PARTITION BY entity_id ORDER BY seg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS to_current FROM seg_ratio""",
)


# The same chain over all meters and days.
CHAIN = ["planted", "contrast", *[f"split{k}" for k in range(5)], "segmented", "seg_stats", "seg_shape", "seg_kinds", "seg_ratio", "seg_factors"]
for name in CHAIN:
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(CHAIN)})\b", r"\1 all_\2", CTES[name])
    cte(f"all_{name}", text.replace("FROM train", "FROM panel") if name == "planted" else text)


@register("window_median_contrast", "entity_id s, date d, pos i, contrast 9", "SELECT * FROM all_contrast")
def window_median_contrast(spark, d):
    return R.window_median_contrast(planted(spark, d, whole=True))


@register("segment_breaks", "entity_id s, date d, seg i, seg_lo i", "SELECT *, lo AS seg_lo FROM all_segmented")
def segment_breaks(spark, d):
    return R.segment_breaks(planted(spark, d, whole=True))


@register(
    "segment_stats",
    "entity_id s, seg i, start d, finish d, n i, level 4, zero_frac 6, n_positive i",
    "SELECT * FROM all_seg_stats",
)
def segment_stats(spark, d):
    return R.segment_stats(R.segment_breaks(planted(spark, d, whole=True))).withColumnRenamed("end", "finish")


@register("classify_breaks", "entity_id s, seg i, break_after s, ratio_after 4", "SELECT * FROM all_seg_ratio")
def classify_breaks(spark, d):
    return R.classify_breaks(R.segment_stats(R.segment_breaks(planted(spark, d, whole=True))))


@register("carry_factors", "entity_id s, seg i, to_current 5", "SELECT * FROM all_seg_factors")
def carry_factors(spark, d):
    return R.regime_segments(planted(spark, d, whole=True))


STATE = (
    "regime_level 6, regime_days i, regime_zero_frac 6, regime_n_breaks i, regime_last_ratio 4, regime_scale_to_current 5, "
    "regime_is_dormant i, regime_cap_violation i"
)
cte(
    "regime_states",
    """
SELECT s.entity_id, ln(1 + s.level) AS regime_level, date_diff('day', s.start, (SELECT max(date) FROM planted)) + 1 AS regime_days,
       s.zero_frac AS regime_zero_frac, s.seg AS regime_n_breaks, coalesce(p.break_after, 'none') AS regime_last_break,
       least(greatest(coalesce(p.ratio_after, 1), 0), 1e6) AS regime_last_ratio, f.to_current AS regime_scale_to_current,
       s.zero_frac >= 0.8 AS regime_is_dormant, s.level > s.capacity * 24 AS regime_cap_violation
FROM seg_factors s LEFT JOIN seg_factors p ON p.entity_id = s.entity_id AND p.seg = s.seg - 1
JOIN seg_factors f ON f.entity_id = s.entity_id AND f.seg = 0
WHERE s.seg = (SELECT max(seg) FROM seg_factors m WHERE m.entity_id = s.entity_id)""",
)


@register("regime_state", f"entity_id s, {STATE}, regime_last_break s", "SELECT * FROM regime_states")
def regime_state(spark, d):
    rows = planted(spark, d)
    return R.regime_state(R.regime_segments(rows), latest_date(rows))


@register(
    "regime_attach",
    f"entity_id s, date d, {STATE.replace('regime_level 6, ', '')}, regime_last_break i",
    """
SELECT t.entity_id, t.date, coalesce(regime_days, 0) AS regime_days, coalesce(regime_zero_frac, 0) AS regime_zero_frac,
       coalesce(regime_n_breaks, 0) AS regime_n_breaks, coalesce(regime_last_ratio, 1) AS regime_last_ratio,
       coalesce(regime_scale_to_current, 1) AS regime_scale_to_current, coalesce(regime_is_dormant, FALSE) AS regime_is_dormant,
       coalesce(regime_cap_violation, FALSE) AS regime_cap_violation,
       list_position(['step', 'scale', 'wake', 'sleep'], regime_last_break) AS code,
       coalesce(list_position(['step', 'scale', 'wake', 'sleep'], regime_last_break), 0) AS regime_last_break
FROM test_rows t LEFT JOIN regime_states s ON s.entity_id = t.entity_id""",
)
def regime_attach(spark, d):
    rows = planted(spark, d)
    return R.attach_state(T.test_rows(spark, d), R.regime_state(R.regime_segments(rows), latest_date(rows)))


@register(
    "normalize_history",
    "entity_id s, date d, value 3, value_raw 2, log_value 6, is_pos i",
    """
SELECT r.entity_id, r.date, r.value * f.to_current AS value, r.value AS value_raw, ln(1 + r.value * f.to_current) AS log_value, r.value * f.to_current > 0 AS is_pos
FROM segmented r JOIN seg_factors f ON f.entity_id = r.entity_id AND f.seg = r.seg""",
)
def normalize_history(spark, d):
    rows = planted(spark, d)
    return R.normalize_history(rows, R.regime_segments(rows))


@register(
    "asof_backward",
    "entity_id s, date d, last_value_date d, last_value 2",
    """
SELECT t.entity_id, t.date, h.date AS last_value_date, h.value AS last_value
FROM test_rows t ASOF LEFT JOIN train h ON h.entity_id = t.entity_id AND h.date <= t.date""",
)
def asof_backward(spark, d):
    known = T.train(spark, d).select("entity_id", "date", F.col("date").alias("last_value_date"), F.col("value").alias("last_value"))
    return nearest_before(T.test_rows(spark, d).select("entity_id", "date"), known, "entity_id", "date", ["last_value_date", "last_value"])


cte(
    "norm_hist",
    """
SELECT p.* REPLACE (r.value * f.to_current AS value, ln(1 + r.value * f.to_current) AS log_value, CASE WHEN r.value * f.to_current > 0 THEN 1 ELSE 0 END AS is_pos),
       month(p.date) AS month, isodow(p.date) - 1 AS dow, w.temperature_2m_mean, w.cdd22, w.cdd_log,
       r.value * f.to_current / (greatest(p.capacity, 1) * 24) AS lf, date_diff('day', p.date, (SELECT max(date) FROM planted)) AS age
FROM train p JOIN segmented r ON r.entity_id = p.entity_id AND r.date = p.date
JOIN seg_factors f ON f.entity_id = r.entity_id AND f.seg = r.seg
LEFT JOIN weather_basic w ON w.district = p.district AND w.date = p.date""",
)


@register(
    "horizon_block",
    f"{MATRIX}, regime_n_breaks i, regime_last_ratio 4, regime_scale_to_current 5, regime_last_break i",
    "SELECT m.*, coalesce(regime_n_breaks, 0) AS regime_n_breaks, coalesce(regime_last_ratio, 1) AS regime_last_ratio, "
    "coalesce(regime_scale_to_current, 1) AS regime_scale_to_current, "
    "coalesce(list_position(['step', 'scale', 'wake', 'sleep'], regime_last_break), 0) AS regime_last_break FROM ("
    + matrix_sql("test_rows", "norm_hist", entity_history_sql("norm_hist"))
    + ") m LEFT JOIN regime_states s ON s.entity_id = m.entity_id",
)
def horizon_block(spark, d):
    rows = enriched(spark, d)
    history = H.before_cutoff(rows, T.CUT).where(~F.col("is_new")).withColumn("value", F.round(F.col("value") * F.expr(PLANT), 2))
    return FT.horizon_block(staged(history.select(*FT.HISTORY)), H.target_window(rows, T.CUT, T.END), T.CUT, regime=True)
