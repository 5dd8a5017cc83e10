"""Load types, serving tables and the queries behind them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelyard.operators import classify as C
from panelyard.operators import marts as M
from panelyard.operators.scale import nearest_within
from panelyard.plans import tables as T
from panelyard.plans.registry import cte, register
from panelyard.session import shared_dir, staged
from panelyard.sources import exports as X
from panelyard.sources import panel as SP
from panelyard.sources import sinks as SK
from panelyard.sources.store import EventStore

ROLES = C.DistrictRoles(
    agro=("NATION_0", "NATION_5", "NATION_6-Z1", "NATION_16-Z0", "NATION_20"),
    tourism=("NATION_2", "NATION_7", "NATION_11-Z2", "NATION_17"),
    industry=("NATION_9", "NATION_11-Z0", "NATION_13", "NATION_19"),
    metro=("NATION_4", "NATION_10", "NATION_14", "NATION_15", "NATION_21-Z1"),
    feast=T.HOLIDAYS.feast,
)


def listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


cte(
    "typed_days",
    f"""
SELECT t.*, w.temp_mean, month(t.date) AS month, isodow(t.date) AS iso FROM train t
LEFT JOIN served_weather w ON w.district = t.district AND w.date = t.date""",
)
cte(
    "metrics_base",
    f"""
SELECT entity_id, any_value(district) AS district, any_value(capacity) AS capacity, count(value) AS days, avg(value) AS mean_t,
       stddev_samp(value) AS std_t, median(value) AS median_t, quantile_cont(value, 0.9) AS p90_t, max(value) AS max_t, min(value) AS min_t,
       avg(CASE WHEN value = 0 THEN 1e0 ELSE 0e0 END) AS zero_ratio, avg(CASE WHEN value < 1 THEN 1e0 ELSE 0e0 END) AS near_zero_ratio,
       avg(value) FILTER (WHERE month IN (6, 7, 8)) AS summer_mean, avg(value) FILTER (WHERE month IN (12, 1, 2)) AS winter_mean,
       avg(value) FILTER (WHERE month IN (3, 4, 5)) AS spring_mean, avg(value) FILTER (WHERE month IN (9, 10, 11)) AS autumn_mean,
       avg(value) FILTER (WHERE iso <= 5) AS wd_mean, avg(value) FILTER (WHERE iso >= 6) AS we_mean, avg(value) FILTER (WHERE iso = 7) AS sun_mean,
       avg(value) FILTER (WHERE date IN ({T.date_list(T.HOLIDAYS.feast)})) AS feast_mean,
       CASE WHEN count(*) > 30 AND stddev_samp(value) > 0 AND stddev_samp(temp_mean) > 0 THEN corr(value, temp_mean) ELSE 0 END AS temp_corr
FROM typed_days GROUP BY 1""",
)
cte(
    "load_metrics",
    """
SELECT *, mean_t / (capacity * 24) AS load_factor, p90_t / (capacity * 24) AS p90_load_factor, std_t / (mean_t + 1e-4) AS cv,
       CASE WHEN winter_mean IS NULL OR winter_mean < 0.1 THEN CASE WHEN summer_mean > 5 THEN 50 ELSE 1 END
            ELSE summer_mean / (winter_mean + 1e-4) END AS sw_ratio,
       CASE WHEN wd_mean > 0.1 THEN we_mean / wd_mean ELSE 1 END AS we_wd_ratio, CASE WHEN wd_mean > 0.1 THEN sun_mean / wd_mean ELSE 1 END AS sun_wd_ratio,
       CASE WHEN wd_mean > 0.1 THEN feast_mean / wd_mean ELSE 1 END AS feast_ratio
FROM metrics_base""",
)
cte(
    "load_rules",
    f"""
SELECT *, CASE WHEN zero_ratio >= 0.75 OR (mean_t < 1 AND near_zero_ratio >= 0.85) THEN 1
    WHEN (sw >= 2.2 AND agro) OR (sw >= 2.8 AND NOT tour) OR (sw >= 1.75 AND agro AND temp_corr > 0.4) THEN 2
    WHEN tour AND (sw >= 1.6 OR (sw >= 1.35 AND we >= 1.02)) THEN 3
    WHEN coalesce(cv, 0) < 0.2 AND we BETWEEN 0.95 AND 1.05 AND su BETWEEN 0.95 AND 1.05 THEN 4
    WHEN sw < 0.7 AND we BETWEEN 0.95 AND 1.05 AND temp_corr < -0.3 THEN 5
    WHEN (capacity >= 400 AND load_factor >= 0.3 AND sw BETWEEN 0.75 AND 1.45 AND (su <= 0.88 OR fe <= 0.8))
         OR (ind AND capacity >= 400 AND load_factor >= 0.25 AND su <= 0.85) OR (capacity >= 630 AND mean_t >= 4000 AND su <= 0.85) THEN 6
    WHEN (su <= 0.82 OR we <= 0.86) AND (metro OR capacity >= 250) THEN 7 ELSE 8 END AS rule
  FROM (SELECT * REPLACE (coalesce(temp_corr, 0) AS temp_corr), coalesce(sw_ratio, 1) AS sw, coalesce(we_wd_ratio, 1) AS we, coalesce(sun_wd_ratio, 1) AS su,
               coalesce(feast_ratio, 1) AS fe, district IN ({listed(ROLES.agro)}) AS agro, district IN ({listed(ROLES.tourism)}) AS tour,
               district IN ({listed(ROLES.industry)}) AS ind, district IN ({listed(ROLES.metro)}) AS metro FROM load_metrics)""",
)
cte(
    "load_types",
    f"""
SELECT entity_id, district, CASE rule WHEN 1 THEN 'Inactive / Standby' WHEN 2 THEN 'Agricultural Irrigation' WHEN 3 THEN 'Tourism & Seasonal Residential'
         WHEN 4 THEN 'Continuous Base Load & Infrastructure' WHEN 5 THEN 'Continuous Base Load & Infrastructure' WHEN 6 THEN 'Industrial & Manufacturing'
         WHEN 7 THEN 'Commercial & Services' ELSE 'Urban Residential' END AS load_type,
       CASE rule WHEN 1 THEN CASE WHEN zero_ratio >= 0.9 THEN 0.96 ELSE 0.88 END WHEN 2 THEN CASE WHEN sw >= 2.5 AND agro THEN 0.93 ELSE 0.86 END
         WHEN 3 THEN CASE WHEN sw >= 1.8 THEN 0.91 ELSE 0.83 END WHEN 4 THEN 0.89 WHEN 5 THEN 0.87
         WHEN 6 THEN CASE WHEN load_factor >= 0.4 AND su <= 0.8 THEN 0.92 ELSE 0.85 END WHEN 7 THEN CASE WHEN su <= 0.75 THEN 0.87 ELSE 0.81 END
         ELSE 0.86 END AS confidence
FROM load_rules""",
)


def metrics(spark, d):
    rows = T.train(spark, d).join(T.served_weather(spark, d), ["district", "date"], "left")
    place = T.train(spark, d).groupBy("entity_id").agg(F.max("district").alias("district"))
    return C.load_metrics(rows, ROLES).join(place, "entity_id")


def classified(spark, d):
    return staged(C.classify_load_type(metrics(spark, d), ROLES))


METRICS = (
    "days i, mean_t 4, std_t 4, median_t 4, p90_t 4, max_t 2, min_t 2, zero_ratio 6, near_zero_ratio 6, summer_mean 4, winter_mean 4, spring_mean 4, "
    "autumn_mean 4, wd_mean 4, we_mean 4, sun_mean 4, feast_mean 4, temp_corr 6, load_factor 6, p90_load_factor 6, cv 6, sw_ratio 6, we_wd_ratio 6, "
    "sun_wd_ratio 6, feast_ratio 6"
)


@register("load_metrics", f"entity_id s, {METRICS}", "SELECT * FROM load_metrics")
def load_metrics(spark, d):
    return metrics(spark, d)


@register("classify_load_type", "entity_id s, district s, load_type s, confidence 2", "SELECT * FROM load_types")
def classify_load_type(spark, d):
    return classified(spark, d)


def said(name: str, digits: int, factor: str = "") -> str:
    return f"round(CAST({name}{factor} AS DOUBLE) + {10.0 ** -(digits + 3)!r}, {digits})"


EXPLAINED = f"""
SELECT entity_id, CASE WHEN rule = 5 THEN '{C.LIGHTING_LOCAL}' ELSE CASE load_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LOCAL_NAMES.items())} END END AS load_type_local,
  CASE rule
    WHEN 1 THEN printf('zero days %.1f%%, daily mean %.2f kWh', {said("zero_ratio", 1, " * 100")}, {said("mean_t", 2)})
    WHEN 2 THEN printf('summer/winter %.2f, temperature correlation %.2f in %s', {said("sw", 2)}, {said("temp_corr", 2)}, upper(district))
    WHEN 3 THEN printf('coastal %s, summer/winter %.2f, weekend/weekday %.2f', upper(district), {said("sw", 2)}, {said("we", 2)})
    WHEN 4 THEN printf('flat profile, variation %.2f, weekend/weekday %.2f', {said("coalesce(cv, 0)", 2)}, {said("we", 2)})
    WHEN 5 THEN printf('winter peak, summer/winter %.2f', {said("sw", 2)})
    WHEN 6 THEN printf('%.0f kVA at load factor %.1f%%, Sunday %.2f, feast %.2f', {said("capacity", 0)}, {said("load_factor", 1, " * 100")}, {said("su", 2)}, {said("fe", 2)})
    WHEN 7 THEN printf('weekday load, Sunday %.2f, summer/winter %.2f', {said("su", 2)}, {said("sw", 2)})
    ELSE printf('balanced seasons %.2f, weekend/weekday %.2f, load factor %.1f%%', {said("sw", 2)}, {said("we", 2)}, {said("load_factor", 1, " * 100")}) END AS explanation
FROM load_rules JOIN (SELECT entity_id AS e, load_type FROM load_types) t ON t.e = entity_id"""


@register("load_type_explanations", "entity_id s, load_type_local s, explanation s", EXPLAINED)
def load_type_explanations(spark, d):
    return classified(spark, d)


cte(
    "type_prior",
    """
SELECT district, load_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY district) AS district_n,
       count(*) / sum(count(*)) OVER (PARTITION BY district) AS share,
       first_value(load_type) OVER (PARTITION BY district ORDER BY count(*) DESC, load_type) AS dominant
FROM load_types GROUP BY 1, 2""",
)


@register("district_type_prior", "district s, load_type s, n i, district_n i, share 6, dominant s", "SELECT * FROM type_prior")
def district_type_prior(spark, d):
    return C.district_type_prior(classified(spark, d))


# Cold forecasts: the new meters' first forecast version.
cte(
    "cold_metrics",
    """
SELECT entity_id, any_value(capacity) AS capacity, any_value(district) AS district, avg(pred) AS sub_mean, avg(CASE WHEN pred = 0 THEN 1e0 ELSE 0e0 END) AS sub_zero_ratio,
       stddev_samp(pred) AS sub_std, max(pred) AS sub_max, min(pred) AS sub_min, avg(pred) / (any_value(capacity) * 24) AS pred_lf, stddev_samp(pred) / (avg(pred) + 1e-4) AS pred_cv,
       avg(pred) FILTER (WHERE month(date) IN (6, 7)) / (avg(pred) FILTER (WHERE month(date) IN (4, 5)) + 1e-4) AS pred_ramp,
       CASE WHEN avg(pred) FILTER (WHERE isodow(date) <= 5) > 0.1
            THEN avg(pred) FILTER (WHERE isodow(date) >= 6) / avg(pred) FILTER (WHERE isodow(date) <= 5) ELSE 1 END AS pred_we_wd
FROM forecasts WHERE version = 'v2' AND NOT seen GROUP BY 1""",
)


def cold(spark, d):
    rows = T.forecasts(spark, d, ["v2"]).where(~F.col("seen"))
    return C.forecast_metrics(rows)


@register(
    "forecast_metrics",
    "entity_id s, district s, sub_mean 4, sub_std 4, sub_max 4, sub_min 4, sub_zero_ratio 6, pred_lf 6, pred_cv 6, pred_ramp 6, pred_we_wd 6",
    "SELECT * FROM cold_metrics",
)
def forecast_metrics(spark, d):
    return cold(spark, d)


def band_sql(reach: int) -> str:
    return f"""
SELECT c.*, (SELECT arg_min(t.load_type, (abs(CAST(substr(t.entity_id, 4, 6) AS INTEGER) - CAST(substr(c.entity_id, 4, 6) AS INTEGER)), CAST(substr(t.entity_id, 4, 6) AS INTEGER), t.load_type))
             FROM load_types t WHERE t.district = c.district
             AND abs(CAST(substr(t.entity_id, 4, 6) AS INTEGER) - CAST(substr(c.entity_id, 4, 6) AS INTEGER)) <= {reach}) AS neighbor_type
FROM cold_metrics c"""


cte("neighbours", band_sql(200))


@register("nearest_id_band_join", "entity_id s, district s, neighbor_type s", "SELECT * FROM neighbours")
def nearest_id_band_join(spark, d):
    return C.nearest_neighbour_type(cold(spark, d), classified(spark, d))


@register(
    "nearest_part_band",
    "o_orderkey i, near_size 0, gap 0",
    """
SELECT o_orderkey, near_size, abs(o_custkey - near_size) AS gap
FROM (SELECT o_orderkey, o_custkey, (SELECT min(x[2]) FROM (SELECT min([abs(l.k - o.o_custkey), l.k]) AS x FROM
             (SELECT DISTINCT l_partkey * 7 AS k, l_returnflag AS f FROM lineitem) l WHERE l.f = CASE o.o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END
             AND abs(l.k - o.o_custkey) <= 5)) AS near_size FROM orders o)""",
)
def nearest_part_band(spark, d):
    # Closest shipped part number to a customer number, per status: many rows per key, a narrow reach.
    flag = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    asked = T.table(spark, d, "orders").select("o_orderkey", flag.alias("flag"), F.col("o_custkey").alias("num"))
    known = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_partkey") * 7).alias("num"), (F.col("l_partkey") * 7).alias("size"))
    out = nearest_within(asked, known, "flag", "num", 5, {"near_size": "size"})
    return out.withColumns({"near_size": F.col("near_size").cast("double"), "gap": F.abs(F.col("num") - F.col("near_size")).cast("double")})


cte(
    "cold_types",
    f"""
SELECT entity_id, district, CASE rule WHEN 1 THEN 'Inactive / Standby' WHEN 2 THEN 'Agricultural Irrigation' WHEN 3 THEN 'Tourism & Seasonal Residential'
         WHEN 4 THEN 'Industrial & Manufacturing' WHEN 5 THEN 'Commercial & Services' WHEN 6 THEN 'Continuous Base Load & Infrastructure'
         ELSE coalesce(dominant, 'Urban Residential') END AS load_type,
       CASE rule WHEN 1 THEN 0.85 WHEN 2 THEN CASE WHEN agro THEN 0.82 ELSE 0.75 END WHEN 3 THEN 0.84 WHEN 4 THEN 0.81 WHEN 5 THEN 0.78 WHEN 6 THEN 0.77
         ELSE CASE WHEN coalesce(dominant, 'Urban Residential') = 'Urban Residential' THEN 0.8 ELSE 0.72 END END AS confidence
FROM (SELECT *, CASE WHEN sub_mean < 5 OR sub_zero_ratio > 0.8 THEN 1
    WHEN (agro AND ramp >= 1.12) OR (ramp >= 1.2 AND NOT tour) OR (nb = 'Agricultural Irrigation' AND agro) THEN 2
    WHEN tour AND (ramp >= 1.08 OR pred_we_wd >= 1 OR nb = 'Tourism & Seasonal Residential') THEN 3
    WHEN (ind AND capacity >= 400 AND pred_lf >= 0.08) OR (capacity >= 630 AND nb = 'Industrial & Manufacturing') THEN 4
    WHEN (metro AND capacity >= 250 AND pred_we_wd < 0.99) OR nb = 'Commercial & Services' THEN 5
    WHEN ramp < 1.03 AND abs(pred_we_wd - 1) < 0.01 AND nb = 'Continuous Base Load & Infrastructure' THEN 6 ELSE 7 END AS rule
  FROM (SELECT n.* REPLACE (coalesce(pred_we_wd, 1) AS pred_we_wd), coalesce(neighbor_type, '') AS nb, coalesce(pred_ramp, 1) AS ramp, p.dominant,
               n.district IN ({listed(ROLES.agro)}) AS agro, n.district IN ({listed(ROLES.tourism)}) AS tour,
               n.district IN ({listed(ROLES.industry)}) AS ind, n.district IN ({listed(ROLES.metro)}) AS metro
        FROM neighbours n LEFT JOIN (SELECT DISTINCT district, dominant FROM type_prior) p ON p.district = n.district))""",
)


def cold_types(spark, d):
    return C.classify_cold_load_type(cold(spark, d), classified(spark, d), ROLES)


@register("classify_cold_load_type", "entity_id s, district s, load_type s, confidence 2", "SELECT * FROM cold_types")
def classify_cold_load_type(spark, d):
    return cold_types(spark, d)


VERSION = "v1"
cte(
    "master",
    f"""
SELECT coalesce(te.entity_id, tr.entity_id) AS entity_id, coalesce(te.capacity, tr.capacity) AS capacity, coalesce(te.location, tr.location) AS location,
       coalesce(te.province, tr.province) AS province, coalesce(te.region, tr.region) AS region, coalesce(te.district, tr.district) AS district,
       CASE WHEN te.entity_id IS NULL THEN 'Train Only' WHEN tr.entity_id IS NULL THEN 'Cold Start' ELSE 'Seen' END AS status,
       coalesce(tr.n, 0) AS train_days, round(tr.m + 1e-5, 2) AS train_mean, round(tr.sd + 1e-5, 2) AS train_std, round(tr.lo + 1e-5, 2) AS train_min,
       round(tr.hi + 1e-5, 2) AS train_max, round(tr.s + 1e-5, 2) AS train_sum, round(p.m + 1e-5, 2) AS pred_mean, round(p.hi + 1e-5, 2) AS pred_max, round(p.s + 1e-5, 2) AS pred_sum,
       CASE WHEN tr.m > 0 THEN (p.m - tr.m) / tr.m * 100 END AS yoy_pct
FROM (SELECT entity_id, any_value(capacity) AS capacity, any_value(location) AS location, any_value(province) AS province, any_value(region) AS region,
             any_value(district) AS district, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, sum(value) AS s
      FROM train GROUP BY 1) tr
FULL JOIN (SELECT entity_id, any_value(capacity) AS capacity, any_value(location) AS location, any_value(province) AS province, any_value(region) AS region,
                  any_value(district) AS district FROM test_rows GROUP BY 1) te ON te.entity_id = tr.entity_id
LEFT JOIN (SELECT entity_id, avg(pred) AS m, max(pred) AS hi, sum(pred) AS s FROM forecasts WHERE version = '{VERSION}' GROUP BY 1) p
       ON p.entity_id = coalesce(te.entity_id, tr.entity_id)""",
)


def master(spark, d):
    return staged(M.entity_master(T.train(spark, d), T.test_rows(spark, d), T.forecasts(spark, d), VERSION))


@register(
    "entity_master",
    "entity_id s, capacity 1, location s, province s, region s, district s, status s, train_days i, train_mean 2, train_std 2, train_min 2, "
    "train_max 2, train_sum 2, pred_mean 2, pred_max 2, pred_sum 2, yoy_pct 2",
    "SELECT * FROM master",
)
def entity_master(spark, d):
    return master(spark, d)


@register("entity_status", "entity_id s, status s, district s", "SELECT * FROM master")
def entity_status(spark, d):
    return M.entity_status(T.train(spark, d), T.test_rows(spark, d))


cte(
    "typed_master",
    """
SELECT m.*, coalesce(l.load_type, c.load_type, 'Urban Residential') AS load_type, coalesce(l.confidence, c.confidence, 0.7) AS confidence,
       k.load_factor, k.sw_ratio, k.zero_ratio, k.temp_corr
FROM master m LEFT JOIN load_types l ON l.entity_id = m.entity_id LEFT JOIN cold_types c ON c.entity_id = m.entity_id
LEFT JOIN load_metrics k ON k.entity_id = m.entity_id""",
)


def typed(spark, d):
    known = classified(spark, d)
    columns = ("entity_id", "load_type", "load_type_local", "confidence", "explanation")
    new = C.classify_cold_load_type(cold(spark, d), known, ROLES)
    types = known.select(*columns).unionByName(new.select(*columns))
    return staged(C.load_type_mart(master(spark, d), types, known))


@register(
    "load_type_mart",
    "entity_id s, status s, load_type s, confidence 2, train_days i, train_mean 2, pred_mean 2, load_factor 4, sw_ratio 2, zero_ratio 3, temp_corr 3",
    "SELECT * REPLACE (coalesce(train_mean, 0) AS train_mean, coalesce(pred_mean, 0) AS pred_mean) FROM typed_master",
)
def load_type_mart(spark, d):
    return typed(spark, d)


@register(
    "status_crosstab",
    "load_type s, seen i, cold_start i, train_only i",
    """
SELECT load_type, count(*) FILTER (WHERE status = 'Seen') AS seen, count(*) FILTER (WHERE status = 'Cold Start') AS cold_start,
       count(*) FILTER (WHERE status = 'Train Only') AS train_only FROM typed_master GROUP BY 1""",
)
def status_crosstab(spark, d):
    return C.status_crosstab(typed(spark, d))


@register(
    "entity_search",
    "entity_id s, province s, status s, capacity 1",
    """
SELECT * FROM master WHERE status = 'Seen' AND capacity >= 100 AND capacity <= 1000 AND (lower(entity_id) LIKE '%nation_1%' OR lower(location) LIKE '%nation_1%')""",
)
def entity_search(spark, d):
    return M.entity_search(master(spark, d), province="All", status="Seen", capacity_min=100, capacity_max=1000, text=" nation_1 ")


@register(
    "distinct_facets",
    "facet s, parent s, value s",
    """
SELECT DISTINCT 'province' AS facet, '' AS parent, province AS value FROM master UNION SELECT 'district', province, district FROM master
UNION SELECT 'region', '', region FROM master UNION SELECT 'version', '', version FROM forecasts
UNION SELECT 'capacity', 'min', CAST(CAST(min(capacity) AS INTEGER) AS VARCHAR) FROM master
UNION SELECT 'capacity', 'max', CAST(CAST(max(capacity) AS INTEGER) AS VARCHAR) FROM master""",
)
def distinct_facets(spark, d):
    return M.distinct_facets(master(spark, d), T.forecasts(spark, d))


@register(
    "paged_list",
    "entity_id s, train_mean 2",
    "SELECT entity_id, train_mean FROM master ORDER BY train_mean DESC NULLS LAST, entity_id LIMIT 5 OFFSET 3",
)
def paged_list(spark, d):
    return M.paged_list(master(spark, d), "train_mean", True, limit=5, offset=3)


@register(
    "paged_list_deep",
    "entity_id s, train_mean 2",
    """
SELECT entity_id || '@' || CAST(date AS VARCHAR) AS entity_id, nullif(value, 0) AS train_mean FROM panel
ORDER BY 2 DESC NULLS LAST, 1 LIMIT 40 OFFSET 4000""",
)
def paged_list_deep(spark, d):
    """A page far down a list of single readings, NULLs and ties among them."""
    reading = F.concat_ws("@", "entity_id", F.col("date").cast("string"))
    rows = T.panel(spark, d).select(reading.alias("entity_id"), F.expr("nullif(value, 0)").alias("train_mean"))
    return M.paged_list(rows, "train_mean", True, limit=40, offset=4000, shallow=1000)


@register(
    "district_summary",
    "province s, district s, n i, seen_n i, cold_n i, total_capacity 1, total_train_mean 2",
    """
SELECT province, district, count(*) AS n, count(*) FILTER (WHERE status = 'Seen') AS seen_n, count(*) FILTER (WHERE status = 'Cold Start') AS cold_n,
       sum(capacity) AS total_capacity, sum(train_mean) AS total_train_mean FROM master GROUP BY 1, 2""",
)
def district_summary(spark, d):
    return M.district_summary(master(spark, d))


@register(
    "global_stats",
    "entities i, seen i, cold_start i, train_only i, districts i, history_range s, forecast_range s",
    """
SELECT count(*) AS entities, count(*) FILTER (WHERE status = 'Seen') AS seen, count(*) FILTER (WHERE status = 'Cold Start') AS cold_start,
       count(*) FILTER (WHERE status = 'Train Only') AS train_only, count(DISTINCT district) AS districts,
       (SELECT min(date)::VARCHAR || ' to ' || max(date)::VARCHAR FROM train) AS history_range,
       (SELECT min(date)::VARCHAR || ' to ' || max(date)::VARCHAR FROM test_rows) AS forecast_range FROM master""",
)
def global_stats(spark, d):
    return M.global_stats(master(spark, d), T.train(spark, d), T.test_rows(spark, d))


cte("seen_ids", "SELECT entity_id FROM train INTERSECT SELECT entity_id FROM test_rows")


@register(
    "district_history",
    "province s, district s, date d, total 2, average 2, n i, seen_total 2, seen_average 2, seen_n i",
    """
SELECT province, district, date, sum(value) AS total, avg(value) AS average, count(*) AS n, coalesce(sum(value) FILTER (WHERE s), 0) AS seen_total,
       coalesce(avg(value) FILTER (WHERE s), 0) AS seen_average, count(*) FILTER (WHERE s) AS seen_n
FROM (SELECT *, entity_id IN (SELECT entity_id FROM seen_ids) AS s FROM train) GROUP BY 1, 2, 3""",
)
def district_history(spark, d):
    train = T.train(spark, d)
    return M.district_history(train, M.seen_entities(train, T.test_rows(spark, d)))


VERSION_COLUMNS = ", ".join(f"{v} 2, {v}_seen 2, {v}_avg 2, {v}_seen_avg 2" for v in T.VERSIONS)
cte(
    "version_days",
    """
SELECT province, district, date, version, sum(pred) AS total, coalesce(sum(pred) FILTER (WHERE s), 0) AS part, count(*) AS n, count(*) FILTER (WHERE s) AS seen_n
FROM (SELECT *, entity_id IN (SELECT entity_id FROM seen_ids) AS s FROM forecasts) GROUP BY 1, 2, 3, 4""",
)
PICKS = ", ".join(
    f"max(total) FILTER (WHERE version = '{v}') AS {v}, max(part) FILTER (WHERE version = '{v}') AS {v}_seen, "
    f"max(round(total + 1e-5, 2) / n) FILTER (WHERE version = '{v}') AS {v}_avg, "
    f"max(CASE WHEN seen_n > 0 THEN round(part + 1e-5, 2) / seen_n ELSE 0 END) FILTER (WHERE version = '{v}') AS {v}_seen_avg"
    for v in T.VERSIONS
)


@register(
    "district_forecasts",
    f"province s, district s, date d, n i, seen_n i, {VERSION_COLUMNS}",
    f"SELECT province, district, date, max(n) AS n, max(seen_n) AS seen_n, {PICKS} FROM version_days GROUP BY 1, 2, 3",
)
def district_forecasts(spark, d):
    return M.district_forecasts(T.forecasts(spark, d), M.seen_entities(T.train(spark, d), T.test_rows(spark, d)), T.VERSIONS)


@register(
    "version_stats",
    "version s, row_count i, mean_pred 4, max_pred 4, sum_pred 2",
    "SELECT version, count(*) AS row_count, avg(pred) AS mean_pred, max(pred) AS max_pred, sum(pred) AS sum_pred FROM forecasts GROUP BY 1",
)
def version_stats(spark, d):
    return M.version_stats(T.forecasts(spark, d))


@register(
    "entity_timeline",
    "entity_id s, date d, series s, day_label s, value 2, temp 2",
    """
SELECT x.entity_id, x.date, series, strftime(x.date, '%d-%m (') || lower(strftime(x.date, '%a')) || ')' AS day_label, value, w.temp_mean AS temp
FROM (SELECT entity_id, district, date, 'history' AS series, value FROM train
      UNION ALL SELECT entity_id, district, date, version, pred FROM forecasts WHERE version IN ('v1', 'v3')) x
LEFT JOIN served_weather w ON w.district = x.district AND w.date = x.date""",
)
def entity_timeline(spark, d):
    return M.entity_timeline(T.train(spark, d), T.forecasts(spark, d), T.served_weather(spark, d), ["v1", "v3"])


cte(
    "aligned_years",
    """
SELECT f.entity_id, f.version, f.date, f.date - INTERVAL 1 YEAR AS hist_date, strftime(f.date, '%d-%m (') || lower(strftime(f.date, '%a')) || ')' AS day_label,
       strftime(f.date - INTERVAL 1 YEAR, '%d-%m (') || lower(strftime(f.date - INTERVAL 1 YEAR, '%a')) || ')' AS hist_day_label,
       t.value AS hist_val, f.pred, a.temp_mean AS pred_temp, b.temp_mean AS hist_temp
FROM forecasts f LEFT JOIN train t ON t.entity_id = f.entity_id AND t.date = f.date - INTERVAL 1 YEAR
LEFT JOIN served_weather a ON a.district = f.district AND a.date = f.date
LEFT JOIN served_weather b ON b.district = f.district AND b.date = f.date - INTERVAL 1 YEAR""",
)


@register(
    "yoy_alignment",
    "entity_id s, version s, date d, hist_date d, day_label s, hist_day_label s, hist_val 2, pred 2, pred_temp 2, hist_temp 2",
    "SELECT * FROM aligned_years",
)
def yoy_alignment(spark, d):
    return M.yoy_alignment(T.forecasts(spark, d), T.train(spark, d), T.served_weather(spark, d))


@register(
    "comparison_table",
    "entity_id s, date d, period s, temp 2, hist_val 2, pred 2, delta_pct 1",
    """
SELECT t.entity_id, t.date, 'Historical' AS period, w.temp_mean AS temp, t.value AS hist_val, CAST(NULL AS DOUBLE) AS pred, CAST(NULL AS DOUBLE) AS delta_pct
FROM (SELECT * FROM train QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) <= 30) t
LEFT JOIN served_weather w ON w.district = t.district AND w.date = t.date
UNION ALL
SELECT entity_id, date, 'Forecast', pred_temp, hist_val, pred,
       CASE WHEN hist_val > 0 AND round(pred + 1e-5, 2) <> 0 THEN (round(pred + 1e-5, 2) - hist_val) / hist_val * 100 END
FROM aligned_years WHERE version = 'v2'""",
)
def comparison_table(spark, d):
    return M.comparison_table(T.forecasts(spark, d, ["v2"]), T.train(spark, d), T.served_weather(spark, d), "v2")


@register(
    "monthly_summary",
    "entity_id s, month s, hist_avg 2, hist_sum 2, v1_avg 2, v1_sum 2, v3_avg 2, v3_sum 2, temp_avg 1",
    """
SELECT coalesce(h.entity_id, f.entity_id, w.entity_id) AS entity_id, coalesce(h.month, f.month, w.month) AS month, h.a AS hist_avg, h.s AS hist_sum,
       f.v1a AS v1_avg, f.v1s AS v1_sum, f.v3a AS v3_avg, f.v3s AS v3_sum, w.t AS temp_avg
FROM (SELECT entity_id, strftime(date, '%Y-%m') AS month, avg(value) AS a, sum(value) AS s FROM train GROUP BY 1, 2) h
FULL JOIN (SELECT entity_id, strftime(date, '%Y-%m') AS month, avg(pred) FILTER (WHERE version = 'v1') AS v1a, sum(pred) FILTER (WHERE version = 'v1') AS v1s,
                  avg(pred) FILTER (WHERE version = 'v3') AS v3a, sum(pred) FILTER (WHERE version = 'v3') AS v3s FROM forecasts GROUP BY 1, 2) f
       ON f.entity_id = h.entity_id AND f.month = h.month
FULL JOIN (SELECT e.entity_id, m.month, m.t FROM (SELECT entity_id, district FROM train UNION SELECT entity_id, district FROM test_rows) e
           JOIN (SELECT district, strftime(date, '%Y-%m') AS month, avg(temp_mean) AS t FROM served_weather GROUP BY 1, 2) m USING (district)) w
       ON w.entity_id = coalesce(h.entity_id, f.entity_id) AND w.month = coalesce(h.month, f.month)""",
)
def monthly_summary(spark, d):
    return M.monthly_summary(T.train(spark, d), T.forecasts(spark, d), T.served_weather(spark, d), ["v1", "v3"])


@register(
    "sibling_nav",
    "entity_id s, prev_id s, next_id s, district_count i",
    """
SELECT entity_id, coalesce(lag(entity_id) OVER w, last_value(entity_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_id,
       coalesce(lead(entity_id) OVER w, first_value(entity_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_id,
       count(*) OVER (PARTITION BY district) AS district_count
FROM master WINDOW w AS (PARTITION BY district ORDER BY train_mean DESC NULLS LAST, entity_id)""",
)
def sibling_nav(spark, d):
    return M.sibling_nav(master(spark, d))


@register(
    "customer_nav",
    "entity_id s, prev_id s, next_id s, district_count i",
    """
SELECT entity_id, coalesce(lag(entity_id) OVER w, last_value(entity_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_id,
       coalesce(lead(entity_id) OVER w, first_value(entity_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_id,
       count(*) OVER (PARTITION BY district) AS district_count
FROM (SELECT c_name AS entity_id, c_mktsegment AS district, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS train_mean FROM customer)
WINDOW w AS (PARTITION BY district ORDER BY train_mean DESC NULLS LAST, entity_id)""",
)
def customer_nav(spark, d):
    rows = T.table(spark, d, "customer").select(
        F.col("c_name").alias("entity_id"), F.col("c_mktsegment").alias("district"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("train_mean")
    )
    return M.sibling_nav(rows)


CATALOG = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
CATALOG_WIDTH = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6}


@register(
    "table_catalog",
    "table_name s, row_count i, column_count i",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, len((SELECT any_value(x) FROM (SELECT map_keys(to_json(t)::MAP(VARCHAR, JSON)) AS x FROM {t} t LIMIT 1))) AS column_count"
        for t in CATALOG
    ),
)
def table_catalog(spark, d):
    return M.table_catalog({t: T.table(spark, d, t) for t in CATALOG})


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "read_panel",
    "entity_id s, date d, capacity 1, value 4, province s, region s, district s, log_value 6, is_pos i",
    "SELECT * REPLACE (ln(1 + value) AS log_value, value > 0 AS is_pos) FROM clean_logged",
)
def read_panel(spark, d):
    # The readings written out under the public column names, then read, repaired and parsed.
    path = scratch(spark, "panel")
    names = {"entity_id": "tanim", "capacity": "guc", "date": "tarih", "value": "tuketim", "location": "lokasyon"}
    raw = T.panel(spark, d).select([F.col(s).alias(n) for s, n in names.items()])
    raw.write.option("header", True).csv(path)
    return SP.read_panel(spark, path)


@register(
    "read_hourly_export",
    "date d, hour i, value 2",
    "SELECT date, hour, value FROM (SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, round(sum(value) + 1e-7, 2) AS value FROM events GROUP BY 1, 2)",
)
def read_hourly_export(spark, d):
    # Two overlapping exports with local numerals; the later one carries other values for its hours and loses.
    hours = T.table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.round(F.sum("value") + 1e-7, 2).alias("value")
    )

    def exported(rows, factor: int):
        cents = F.round(F.col("value") * 100).cast("bigint") * factor
        number = F.translate(F.format_string("%,.2f", cents / 100), ",.", ".,")
        return rows.select(
            F.date_format("date", "dd.MM.yyyy").alias("Tarih"), F.format_string("%02d:00", "hour").alias("Saat"), number.alias("Yük Tahmin Planı (MWh) ")
        )

    folder = scratch(spark, "hourly")
    paths = []
    for name, factor in (("a", 1), ("b", 3)):
        exported(hours, factor).withColumn("Tarih", F.col("Tarih")).write.option("header", True).option("sep", ";").csv(f"{folder}/{name}")
        paths.append(f"{folder}/{name}")
    return X.read_hourly_export(spark, paths)


@register(
    "read_hourly_mapped",
    "date d, hour i, total 2, gas 2, wind 2, solar 2, dam 2",
    """
SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, round(sum(value) + 1e-7, 2) AS total, round(sum(value) FILTER (WHERE event_type = 'view') + 1e-7, 2) AS gas,
       round(sum(value) FILTER (WHERE event_type = 'click') + 1e-7, 2) AS wind, round(sum(value) FILTER (WHERE event_type = 'purchase') + 1e-7, 2) AS solar,
       round(sum(value) FILTER (WHERE event_type = 'signup') + 1e-7, 2) AS dam FROM events GROUP BY 1, 2""",
)
def read_hourly_mapped(spark, d):
    kinds = {"Toplam(MWh)": None, "Doğalgaz": "view", "Rüzgar": "click", "Gunes": "purchase", "Barajlı": "signup"}
    sums = [F.sum(F.col("value") if k is None else F.when(F.col("event_type") == k, F.col("value"))).alias(n) for n, k in kinds.items()]
    hours = T.table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(*sums)
    texts = [F.translate(F.format_string("%,.2f", F.round(F.col(f"`{n}`") + 1e-7, 2)), ",.", ".,") for n in kinds]
    path = scratch(spark, "mapped")
    hours.select(
        F.date_format("date", "dd.MM.yyyy").alias("Tarih"), F.format_string("%02d:00", "hour").alias("Saat"),
        *[F.when(F.col(f"`{n}`").isNotNull(), t).alias(n) for n, t in zip(kinds, texts)],
    ).write.option("header", True).option("sep", ";").csv(path)
    return X.read_hourly_mapped(spark, [path], X.GENERATION_PLAN)


SEGMENT_OF = {"BUILDING": "Mesken (MWh)", "AUTOMOBILE": "Sanayi (MWh)", "MACHINERY": "Tarımsal Sulama (MWh)"}
cte(
    "province_months",
    """
SELECT n_name AS province, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice) + 1e-7, 2) AS total,
       round(sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') + 1e-7, 2) AS residential,
       round(sum(o_totalprice) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') + 1e-7, 2) AS industry,
       round(sum(o_totalprice) FILTER (WHERE c_mktsegment = 'MACHINERY') + 1e-7, 2) AS irrigation
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""",
)


def province_text(spark, d):
    orders, customer, nation = (T.table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [F.sum(F.when(F.col("c_mktsegment") == s, F.col("o_totalprice"))).alias(n) for s, n in SEGMENT_OF.items()]
    sums = rows.groupBy(F.col("n_name").alias("province"), F.date_trunc("month", "o_orderdate").alias("m")).agg(
        F.sum("o_totalprice").alias("Genel Toplam (MWh)"), *parts
    )
    names = ["Genel Toplam (MWh)", *SEGMENT_OF.values()]
    texts = [F.translate(F.format_string("%,.2f", F.round(F.col(f"`{n}`") + 1e-7, 2)), ",.", ".,") for n in names]
    return sums.select("province", F.col("m"), *[F.when(F.col(f"`{n}`").isNotNull(), t).alias(n) for n, t in zip(names, texts)])


@register(
    "read_province_monthly",
    "province s, month d, year i, month_no i, days i, total 2, residential 2, industry 2, irrigation 2, daily_mean 4",
    """
SELECT *, year(month) AS year, month(month) AS month_no, day(last_day(month)) AS days, total / day(last_day(month)) AS daily_mean FROM province_months""",
)
def read_province_monthly(spark, d):
    # A stale download repeats every month with other numbers; the file that sorts last wins.
    text = province_text(spark, d).withColumn("Dönem", F.date_format("m", "MM.yyyy")).drop("m")
    stale = text.withColumn("Genel Toplam (MWh)", F.lit("1,00"))
    folder = scratch(spark, "province")
    for name, part in (("1", stale), ("2", text)):
        # a folder per province below the download, as the partition column names it
        part.withColumn("place", F.col("province")).drop("province").write.partitionBy("place").option("header", True).option("sep", ";").csv(f"{folder}/{name}")
    names = [r[0] for r in T.table(spark, d, "nation").select("n_name").collect()]  # a catalogue of provinces
    return X.read_province_monthly(spark, {n: [f"{folder}/{k}/place={n}" for k in ("1", "2")] for n in names})


@register(
    "province_periods",
    "city s, period s, total 2, residential 2",
    "SELECT upper(province) AS city, strftime(month, '%Y-%m') AS period, total, residential FROM province_months",
)
def province_periods(spark, d):
    text = province_text(spark, d).withColumn(
        "Dönem", F.when(F.month("m") % 2 == 0, F.date_format("m", "M.yyyy")).otherwise(F.date_format("m", "d.M.yyyy"))
    )
    raw = text.withColumnRenamed("province", "Şehir").withColumn("Şehir", F.concat(F.lit(" "), F.lower("Şehir"))).drop("m")
    path = scratch(spark, "periods")
    raw.write.option("header", True).option("sep", ";").csv(path)
    return X.province_periods(X.read_exports(spark, [path]))


@register(
    "read_coords",
    "district s, lat 3, lon 3",
    "SELECT n_name AS district, 30 + n_nationkey / 4e0 AS lat, 20 + n_nationkey / 2e0 AS lon FROM nation",
)
def read_coords(spark, d):
    return coords(spark, d)


def coords(spark, d):
    pair = F.array(30 + F.col("n_nationkey") / 4, 20 + F.col("n_nationkey") / 2)
    entry = F.map_from_entries(F.collect_list(F.struct("n_name", pair)))
    path = scratch(spark, "coords")
    # The nations form one small JSON map, as in the public file.
    T.table(spark, d, "nation").agg(F.to_json(entry).alias("value")).coalesce(1).write.text(path)
    return SP.read_coords(spark, path)


@register(
    "geo_attach",
    "district s, lat 3, lon 3",
    """
SELECT DISTINCT p.district, 30 + n_nationkey / 4e0 AS lat, 20 + n_nationkey / 2e0 AS lon FROM panel p LEFT JOIN nation ON n_name = p.district""",
)
def geo_attach(spark, d):
    return SP.geo_attach(T.panel(spark, d).select("district").distinct(), coords(spark, d))


@register(
    "read_json_reports",
    "event_type s, is_report i, has_size i, has_time i, headline_metric s, headline_value s, content s",
    """
SELECT event_type, TRUE AS is_report, TRUE AS has_size, TRUE AS has_time, CASE WHEN event_type <> 'view' THEN 'cv_mean' END AS headline_metric,
       CASE WHEN event_type <> 'view' THEN CAST(cents AS VARCHAR) END AS headline_value,
       '{"event":"' || event_type || CASE WHEN event_type = 'view' THEN '","other":' || CAST(cents AS VARCHAR) ELSE '","cv_mean":' || CAST(cents AS VARCHAR) || ',"lb":1' END || '}' || chr(10) AS content
FROM (SELECT event_type, CAST(round(avg(value) * 100 + 1e-7) AS BIGINT) AS cents FROM events GROUP BY 1)""",
)
def read_json_reports(spark, d):
    # One report per event type: means under a known key, or only unknown keys.
    kinds = T.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value") * 100 + 1e-7).cast("long").alias("mean"))
    body = F.when(F.col("event_type") == "view", F.to_json(F.struct(F.col("event_type").alias("event"), F.col("mean").alias("other")))).otherwise(
        F.to_json(F.struct(F.col("event_type").alias("event"), F.col("mean").alias("cv_mean"), F.lit(1).alias("lb")))
    )
    path = scratch(spark, "reports")
    kinds.select("event_type", body.alias("value")).repartition("event_type").write.partitionBy("event_type").text(path)
    reports = X.read_json_reports(spark, f"{path}/*/*.txt").withColumn("event_type", F.get_json_object("content", "$.event"))
    # Spark numbers its part files, so the check sees that name, size and time are those of the file.
    return reports.withColumns(
        {"is_report": F.col("file_name").endswith(".txt"), "has_size": F.col("file_size") == F.octet_length("content"), "has_time": F.col("modified").isNotNull()}
    )


@register(
    "json_headlines",
    "event_id i, headline_metric s, headline_value s",
    """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'smape' WHEN event_id % 3 = 1 THEN 'lb' END AS headline_metric,
       CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS headline_value
FROM events WHERE event_type <> 'error'""",
)
def json_headlines(spark, d):
    # Event properties under a known or an unknown key; error events carry text that is not JSON.
    key = F.when(F.col("event_id") % 3 == 0, "smape").when(F.col("event_id") % 3 == 1, "lb").otherwise("k")
    content = F.replace(F.col("props"), F.lit('"k"'), F.concat(F.lit('"'), key, F.lit('"')))
    rows = T.table(spark, d, "events").withColumn("content", F.when(F.col("event_type") == "error", F.lit("{not json")).otherwise(content))
    return X.json_headlines(rows)


@register(
    "upsert_events",
    "user_id i, event_type s, event_id i, value 2",
    """
SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2""",
)
def upsert_events(spark, d):
    events = T.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    middle = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    return X.upsert_events(events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle), ["user_id", "event_type"], "ts")


def stored_events(spark, d):
    """The event table stored in three batches by day; the second is replayed, and the days of the first are no rows' days too."""
    events = T.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts", F.to_date("ts").alias("date"))
    events = events.withColumns({"kind": F.col("event_type"), "province": F.lit("all")})
    store = EventStore(scratch(spark, "store"), ("user_id", "event_type"), "ts", 8)
    day = F.dayofmonth("date")
    days = events.select("kind", "province", "date").distinct()
    for batch, part in enumerate((day <= 10, (day > 10) & (day <= 20), day > 20)):
        for _ in range(2 if batch == 1 else 1):
            store.upsert(events.where(part), batch, days.where(part))
    return store, days


@register(
    "upsert_store",
    "user_id i, event_type s, event_id i, value 2",
    "SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2",
)
def upsert_store(spark, d):
    return stored_events(spark, d)[0].rows(spark)


@register(
    "upsert_ledger",
    "kind s, date d, n i, still_missing i",
    "SELECT event_type AS kind, CAST(ts AS DATE) AS date, count(*) AS n, 0 AS still_missing FROM events GROUP BY 1, 2",
)
def upsert_ledger(spark, d):
    store, days = stored_events(spark, d)
    return store.ledger(spark).withColumn("still_missing", F.lit(store.missing(days).count()))


@register(
    "fetch_ledger",
    "kind s, province s, date d",
    """
SELECT k.kind, p.province, p.date FROM (SELECT DISTINCT o_orderstatus AS province, CAST(o_orderdate AS DATE) AS date FROM orders) p,
       (SELECT unnest(['planned', 'unplanned']) AS kind) k
WHERE NOT (k.kind = 'planned' AND p.date < DATE '1998-01-01') AND NOT (k.kind = 'unplanned' AND month(p.date) = 7)""",
)
def fetch_ledger(spark, d):
    days = T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("province"), F.to_date("o_orderdate").alias("date")).distinct()
    wanted = days.withColumn("kind", F.explode(F.array(F.lit("planned"), F.lit("unplanned"))))
    early = (F.col("kind") == "planned") & (F.col("date") < F.to_date(F.lit("1998-01-01")))
    july = (F.col("kind") == "unplanned") & (F.month("date") == 7)
    return X.fetch_ledger(wanted, wanted.where(early | july))


@register(
    "source_fingerprint",
    "table_name s, files i, rows i, digits i",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, 1 AS files, count(*) AS rows, 12 AS digits FROM {t}" for t in CATALOG),
)
def source_fingerprint(spark, d):
    return X.source_fingerprints({t: T.table(spark, d, t) for t in CATALOG}).withColumn("digits", F.length("print"))


@register(
    "source_fingerprint_files",
    "table_name s, files i, rows i, bytes i, steady i, distinct_from_others i",
    """
SELECT t.name AS table_name, 1 AS files, count(*) AS rows, sum(octet_length(encode(n_name)) + 1 + t.extra) AS bytes, TRUE AS steady, TRUE AS distinct_from_others
FROM nation, (VALUES ('plain', 0), ('longer', 1)) t(name, extra) GROUP BY 1""",
)
def source_fingerprint_files(spark, d):
    """Two text files of known size: the bytes seen, whether a second look prints the same, and whether the files print apart."""
    names = T.table(spark, d, "nation").select(F.col("n_name").alias("value"))
    folder = scratch(spark, "prints")
    for name, text in (("plain", F.col("value")), ("longer", F.concat("value", F.lit("!")))):
        names.select(text.alias("value")).coalesce(1).write.text(f"{folder}/{name}")

    def look():
        return X.source_fingerprints({name: spark.read.text(f"{folder}/{name}") for name in ("plain", "longer")})

    first = staged(look())
    again = look().select(F.col("table_name").alias("t"), F.col("print").alias("again"))
    prints = first.agg(F.count_distinct("print") == 2).scalar()
    rows = first.join(again, F.col("table_name") == F.col("t"))
    return rows.withColumns({"steady": (F.col("print") == F.col("again")) & (F.length("print") == 12), "distinct_from_others": prints})


@register(
    "write_forecast",
    "entity_id s, date d, value 4",
    "SELECT entity_id, date, greatest(exp(pred_c) - 1, 0) AS value FROM scored",
)
def write_forecast(spark, d):
    rows = T.scored(spark, d).withColumn("pred", F.col("pred_c"))
    path = scratch(spark, "forecast")
    SK.write_forecast(rows, rows.count(), path, ["entity_id", "date"])
    return spark.read.option("header", True).schema("entity_id string, date date, value double").csv(path)


@register(
    "write_tables",
    "table_name s, row_count i",
    "SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'orders', count(*) FROM orders",
)
def write_tables(spark, d):
    folder = scratch(spark, "tables")
    SK.write_tables({t: T.table(spark, d, t) for t in ("nation", "orders")}, folder)
    return M.table_catalog({t: spark.read.parquet(f"{folder}/{t}") for t in ("nation", "orders")})
