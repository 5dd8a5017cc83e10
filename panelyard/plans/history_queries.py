"""History aggregates, groups, profiles, holidays, priors and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.weather import weather_basic
from panelyard.operators import clean
from panelyard.operators import features as FT
from panelyard.operators import groups as G
from panelyard.operators import history as H
from panelyard.operators import holiday as HO
from panelyard.operators import priors as P
from panelyard.operators import profiles as PR
from panelyard.operators.scale import exact_quantiles
from panelyard.plans import tables as T
from panelyard.plans.registry import cte, register
from panelyard.plans.text_queries import EDGE_SQL
from panelyard.session import staged


@register(
    "group_slope",
    "entity_id s, slope 6",
    "SELECT entity_id, regr_slope(log_value, cdd22) AS slope FROM hist GROUP BY 1",
)
def group_slope(spark, d):
    return H.group_slope(T.hist(spark, d), ["entity_id"], "cdd22")


def entity_history_sql(source: str) -> str:
    recent = "\n".join(
        f"avg(log_value) FILTER (WHERE age < {w}) AS ent_r{w}_mean, 1 - avg(is_pos) FILTER (WHERE age < {w}) AS ent_r{w}_zero,"
        for w in (7, 28, 91)
    )
    spread = ", ".join(f"stddev_samp(log_value) FILTER (WHERE age < {w}) AS ent_r{w}_std" for w in (28, 91))
    quantiles = ", ".join(f"quantile_cont(log_value, {p / 100}) AS ent_p{p}" for p in (10, 25, 75, 90))
    return f"""
SELECT *, ent_p75 - ent_p25 AS ent_iqr, ent_r28_mean - ent_r91_mean AS ent_trend, ent_r28_zero - ent_zero AS ent_zero_trend,
       ent_summer_mean - ent_mean AS ent_summer_delta, hot - ent_mean AS ent_hot_delta
FROM (SELECT entity_id, avg(log_value) AS ent_mean, median(log_value) AS ent_median, stddev_samp(log_value) AS ent_std,
             min(log_value) AS ent_min, max(log_value) AS ent_max, 1 - avg(is_pos) AS ent_zero, count(*) AS ent_cnt,
             {quantiles}, {recent} {spread},
             regr_slope(log_value, -age) FILTER (WHERE age < 90) AS ent_slope90,
             regr_slope(log_value, cdd22) AS ent_cdd_slope, regr_slope(log_value, cdd_log) AS ent_cddlog_slope,
             avg(log_value) FILTER (WHERE cdd22 > 0) AS ent_summer_mean, avg(log_value) FILTER (WHERE temperature_2m_mean > 25) AS hot,
             avg(lf) AS ent_lf
      FROM {source} GROUP BY entity_id)"""


ENTITY_COLUMNS = (
    "ent_mean 6, ent_median 6, ent_std 6, ent_min 6, ent_max 6, ent_zero 6, ent_cnt 0, ent_p10 6, ent_p25 6, ent_p75 6, "
    "ent_p90 6, ent_iqr 6, ent_r7_mean 6, ent_r7_zero 6, ent_r28_mean 6, ent_r28_zero 6, ent_r28_std 6, ent_r91_mean 6, "
    "ent_r91_zero 6, ent_r91_std 6, ent_trend 6, ent_zero_trend 6, ent_slope90 6, ent_cdd_slope 6, ent_cddlog_slope 6, "
    "ent_summer_mean 6, ent_summer_delta 6, ent_hot_delta 6, ent_lf 6"
)
cte("entity_history", entity_history_sql("hist"))


@register("entity_history", f"entity_id s, {ENTITY_COLUMNS}", "SELECT * FROM entity_history")
def entity_history(spark, d):
    return H.entity_history(T.hist(spark, d))


@register(
    "entity_profiles",
    "entity_id s, month 0, dow 0, level 6",
    """
SELECT entity_id, month, NULL AS dow, avg(log_value) AS level FROM hist GROUP BY 1, 2
UNION ALL SELECT entity_id, NULL, dow, avg(log_value) FROM hist GROUP BY 1, 3""",
)
def entity_profiles(spark, d):
    return H.entity_profiles(T.train(spark, d))


@register(
    "group_levels",
    "level s, district s, capacity 1, month 0, level_mean 6, level_n i, level_lf 6",
    """
SELECT CASE WHEN capacity IS NOT NULL AND district IS NOT NULL THEN 'district_capacity' WHEN capacity IS NOT NULL THEN 'capacity'
            WHEN month IS NOT NULL THEN 'district_month' ELSE 'district' END AS level,
       district, capacity, month, avg(log_value) AS level_mean, count(*) AS level_n, avg(lf) AS level_lf
FROM hist GROUP BY GROUPING SETS ((district), (district, month), (capacity), (district, capacity))""",
)
def group_levels(spark, d):
    return H.group_levels(T.train(spark, d))


@register(
    "capacity_medians",
    "capacity 1, cap_median 6",
    "SELECT capacity, median(log_value) AS cap_median FROM train GROUP BY 1",
)
def capacity_medians(spark, d):
    return H.capacity_medians(T.stored_train(spark, d))


cte(
    "district_dynamics",
    """
SELECT district, regr_slope(log_value, cdd22) AS dist_cdd_slope, regr_slope(log_value, cdd_log) AS dist_cddlog_slope,
       avg(log_value) FILTER (WHERE cdd22 > 0) AS dist_summer_mean,
       avg(log_value) FILTER (WHERE cdd22 > 0) - avg(log_value) AS dist_summer_delta,
       avg(log_value) FILTER (WHERE temperature_2m_mean > 25) - avg(log_value) AS dist_hot_delta,
       avg(log_value) FILTER (WHERE age < 28) AS dist_r28_mean, avg(log_value) FILTER (WHERE age < 91) AS dist_r91_mean,
       avg(log_value) FILTER (WHERE age < 28) - avg(log_value) FILTER (WHERE age < 91) AS dist_trend,
       1 - avg(is_pos) FILTER (WHERE age < 28) AS dist_r28_zero
FROM hist GROUP BY 1""",
)
DYNAMICS = (
    "dist_cdd_slope 6, dist_cddlog_slope 6, dist_summer_mean 6, dist_summer_delta 6, dist_hot_delta 6, dist_r28_mean 6, "
    "dist_r91_mean 6, dist_trend 6, dist_r28_zero 6"
)


@register("district_dynamics", f"district s, {DYNAMICS}", "SELECT * FROM district_dynamics")
def district_dynamics(spark, d):
    return H.district_dynamics(T.hist(spark, d))


cte(
    "peers",
    f"""
SELECT district, {EDGE_SQL} AS capacity_bucket, avg(log_value) AS peer_mean, count(*) AS peer_n
FROM hist WHERE age < 91 GROUP BY 1, 2""",
)


@register("peer_benchmarks", "district s, capacity_bucket i, peer_mean 6, peer_n i", "SELECT * FROM peers")
def peer_benchmarks(spark, d):
    return H.peer_benchmarks(T.train(spark, d))


cte(
    "bucketed",
    "SELECT h.*, len(list_filter(edges, lambda e: e <= ln(1 + capacity) + 1e-12)) AS cap_bucket, dow >= 5 AS weekend FROM hist h, cap_edges",
)
cte(
    "cohorts",
    """
SELECT district, cap_bucket, avg(log_value) AS coh_mean, stddev_samp(log_value) AS coh_cv, count(*) AS coh_n,
       avg(value / (capacity * 24)) AS coh_lf, regr_slope(log_value, cdd22) AS coh_cdd_slope,
       regr_slope(log_value, cdd_log) AS coh_cddlog_slope, regr_slope(log_value, hdd18) AS coh_hdd_slope,
       avg(log_value) FILTER (WHERE weekend) - avg(log_value) FILTER (WHERE NOT weekend) AS coh_dow_amp,
       avg(value / (capacity * 24)) FILTER (WHERE weekend) AS coh_wknd_lf
FROM bucketed GROUP BY 1, 2""",
)
cte(
    "cohort_months",
    """
SELECT district, cap_bucket, month, avg(log_value) - coh_mean AS coh_moy_dev
FROM bucketed JOIN cohorts USING (district, cap_bucket) GROUP BY district, cap_bucket, month, coh_mean""",
)
COHORT = (
    "coh_mean 6, coh_cv 6, coh_n 0, coh_lf 6, coh_cdd_slope 6, coh_cddlog_slope 6, coh_hdd_slope 6, coh_dow_amp 6, coh_wknd_lf 6"
)


@register("cohort_stats", f"district s, cap_bucket i, {COHORT}", "SELECT * FROM cohorts")
def cohort_stats(spark, d):
    rows = T.hist(spark, d)
    return G.cohort_stats(rows, G.capacity_edges(rows))


FILLED = ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in G.COHORT_STATS)


@register(
    "cohort_attach",
    f"entity_id s, date d, {COHORT}, coh_moy_dev 6",
    f"""
SELECT entity_id, date, {FILLED}
FROM (SELECT t.entity_id, t.date, t.district, month(t.date) AS month,
             len(list_filter(edges, lambda e: e <= ln(1 + capacity) + 1e-12)) AS cap_bucket
      FROM test_rows t, cap_edges)
LEFT JOIN cohorts USING (district, cap_bucket) LEFT JOIN cohort_months USING (district, cap_bucket, month)""",
)
def cohort_attach(spark, d):
    return G.attach_cohort(T.test_rows(spark, d), T.hist(spark, d))


cte("life", "SELECT entity_id, CASE WHEN max(value) = 0 THEN 1e0 ELSE 0e0 END AS dead, avg(log_value) AS lvl FROM household_past GROUP BY 1")
cte(
    "prefixes",
    """
SELECT length, prefix, (sum(dead) + 5 * (SELECT avg(dead) FROM life)) / (count(*) + 5) AS dead,
       (sum(lvl) + 10 * (SELECT avg(lvl) FROM life)) / (count(*) + 10) AS level, ln(1 + count(*)) AS n
FROM (SELECT unnest([4, 9]) AS length, * FROM life), LATERAL (SELECT left(entity_id, length) AS prefix) GROUP BY 1, 2""",
)


# Household ids share their first three characters, so prefixes one digit into the number are used.
@register("prefix_rates", "length i, prefix s, dead 6, level 6, n 6", "SELECT * FROM prefixes")
def prefix_rates(spark, d):
    past, _ = T.household_split(spark, d)
    return G.prefix_rates(past, (4, 9))


@register(
    "prefix_attach",
    "entity_id s, pfx4_dead 6, pfx4_mean 6, pfx4_n 6, pfx9_dead 6, pfx9_mean 6, pfx9_n 6",
    """
SELECT e.entity_id, coalesce(a.dead, g.d) AS pfx4_dead, coalesce(a.level, g.l) AS pfx4_mean, coalesce(a.n, 0) AS pfx4_n,
       coalesce(b.dead, g.d) AS pfx9_dead, coalesce(b.level, g.l) AS pfx9_mean, coalesce(b.n, 0) AS pfx9_n
FROM (SELECT DISTINCT entity_id FROM household UNION SELECT DISTINCT entity_id FROM readings) e
LEFT JOIN prefixes a ON a.length = 4 AND a.prefix = left(e.entity_id, 4)
LEFT JOIN prefixes b ON b.length = 9 AND b.prefix = left(e.entity_id, 9)
CROSS JOIN (SELECT avg(dead) AS d, avg(lvl) AS l FROM life) g""",
)
def prefix_attach(spark, d):
    past, _ = T.household_split(spark, d)
    ids = T.household(spark, d).select("entity_id").union(T.readings(spark, d).select("entity_id")).distinct()
    return G.attach_prefix(ids, past, (4, 9))


cte(
    "shift_base",
    """
SELECT entity_id, median(value) FILTER (WHERE recent AND value > 0) AS recent_med, median(value) FILTER (WHERE NOT recent AND value > 0) AS older_med,
       median(value) FILTER (WHERE value > 0) AS life_med, avg(value) FILTER (WHERE recent) AS recent_mean,
       stddev_samp(value) FILTER (WHERE recent) AS recent_std, avg(value) AS life_mean,
       avg(value) FILTER (WHERE month(date) IN (6, 7, 8)) AS summer_mean
FROM (SELECT *, date >= (SELECT max(date) FROM train) - 60 AS recent FROM train) GROUP BY 1""",
)


@register(
    "regime_shift_features",
    "entity_id s, level_shift_ratio 6, recent_vs_lifetime_log_diff 6, recent_load_cv 6, scaled_summer_baseline 6, regime_persistence_days i",
    """
SELECT b.entity_id, b.ratio AS level_shift_ratio,
       greatest(-5, least(5, coalesce(ln(1 + recent_mean) - ln(1 + life_mean), 0))) AS recent_vs_lifetime_log_diff,
       greatest(0, least(5, coalesce(recent_std, 0) / recent_mean)) AS recent_load_cv,
       ln(1 + coalesce(summer_mean * b.ratio, recent_mean)) AS scaled_summer_baseline,
       least(120, s.streak) AS regime_persistence_days
FROM (SELECT *, greatest(0.1, least(10, coalesce(recent_med / older_med, recent_med / life_med, 1))) AS ratio FROM shift_base) b
JOIN (SELECT t.entity_id, count(*) FILTER (WHERE t.date > coalesce(c.calm, DATE '1900-01-01')) AS streak
      FROM train t LEFT JOIN (SELECT t.entity_id, max(date) AS calm FROM train t JOIN shift_base b ON b.entity_id = t.entity_id
                              WHERE t.value <= 1.5 * coalesce(b.life_med, 1) GROUP BY 1) c ON c.entity_id = t.entity_id
      GROUP BY 1) s ON s.entity_id = b.entity_id""",
)
def regime_shift_features(spark, d):
    return PR.regime_shift_features(T.train(spark, d))


@register(
    "elevated_streak",
    "entity_id s, regime_persistence_days i",
    """
SELECT entity_id, least(120, count(*) FILTER (WHERE rn < coalesce(first_calm, 1e9))) AS regime_persistence_days
FROM (SELECT *, min(rn) FILTER (WHERE value <= 1.5 * med) OVER (PARTITION BY entity_id) AS first_calm
      FROM (SELECT entity_id, value, coalesce(median(value) FILTER (WHERE value > 0) OVER (PARTITION BY entity_id), 1) AS med,
                   row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS rn FROM household_past))
GROUP BY 1""",
)
def elevated_streak(spark, d):
    past, _ = T.household_split(spark, d)
    return PR.regime_shift_features(past)


@register(
    "agro_profile",
    "entity_id s, summer_concentration_ratio 6, is_summer_exclusive 0, agro_summer_expansion_ratio 6",
    """
SELECT entity_id, share AS summer_concentration_ratio, CASE WHEN share > 0.8 THEN 1 ELSE 0 END AS is_summer_exclusive,
       CASE WHEN may IS NOT NULL OR late IS NOT NULL
            THEN greatest(0.5, least(5, coalesce(late / CASE WHEN may = 0 THEN 1 ELSE may END, 1))) END AS agro_summer_expansion_ratio
FROM (SELECT entity_id, avg(CASE WHEN month(date) BETWEEN 6 AND 8 THEN 1e0 ELSE 0 END) AS share,
             avg(value) FILTER (WHERE month(date) = 5) AS may, avg(value) FILTER (WHERE month(date) IN (7, 8)) AS late
      FROM household GROUP BY 1)""",
)
def agro_profile(spark, d):
    return PR.agro_profile(T.household(spark, d))


AGRO_DISTRICTS = ("NATION_1", "NATION_4", "NATION_6-Z1", "NATION_11", "NATION_16-Z0")


@register(
    "agro_flags",
    "district s, date d, is_heavy_agro_district 0, agro_district_x_et0 6, is_delayed_start 0",
    f"""
SELECT district, date, heavy AS is_heavy_agro_district, heavy * et0_fao_evapotranspiration AS agro_district_x_et0,
       CASE WHEN month(date) >= 5 THEN heavy ELSE 0 END AS is_delayed_start
FROM (SELECT *, CASE WHEN district IN {AGRO_DISTRICTS} THEN 1e0 ELSE 0e0 END AS heavy FROM weather)""",
)
def agro_flags(spark, d):
    return PR.agro_flags(T.weather(spark, d), AGRO_DISTRICTS)


@register(
    "season_cumulative",
    "district s, date d, cum_water_deficit 6",
    """
SELECT district, date, sum(CASE WHEN month(date) BETWEEN 5 AND 8 THEN greatest(et0_fao_evapotranspiration - rain_sum, 0) ELSE 0 END)
       OVER (PARTITION BY district, year(date) ORDER BY date) AS cum_water_deficit FROM weather""",
)
def season_cumulative(spark, d):
    return PR.season_cumulative(T.weather(spark, d))


@register(
    "archetype_rules",
    "entity_id s, sunday_to_weekday_ratio 6, summer_to_winter_ratio 6, load_volatility_cv 6, archetype_code 0",
    """
SELECT *, CASE WHEN su > 1.15 AND sw > 1.8 THEN 3 WHEN su < 0.4 THEN 4 WHEN su < 0.6 THEN 1 WHEN sw > 3 THEN 2 WHEN cv < 0.2 THEN 5
               ELSE 6 END AS archetype_code, su AS sunday_to_weekday_ratio, sw AS summer_to_winter_ratio, cv AS load_volatility_cv
FROM (SELECT entity_id,
        CASE WHEN sun IS NOT NULL OR wd IS NOT NULL THEN greatest(0.1, least(3, coalesce(sun / CASE WHEN wd = 0 THEN 1 ELSE wd END, 1))) END AS su,
        CASE WHEN summer IS NOT NULL OR winter IS NOT NULL THEN greatest(0.1, least(10, coalesce(summer / CASE WHEN winter = 0 THEN 1 ELSE winter END, 1))) END AS sw,
        greatest(0, least(5, coalesce(sd, 0) / CASE WHEN mean = 0 THEN 1 ELSE mean END)) AS cv
      FROM (SELECT entity_id, avg(value) FILTER (WHERE isodow(date) = 7) AS sun, avg(value) FILTER (WHERE isodow(date) <= 5) AS wd,
                   avg(value) FILTER (WHERE month(date) IN (6, 7, 8)) AS summer, avg(value) FILTER (WHERE month(date) IN (1, 2, 12)) AS winter,
                   stddev_samp(value) AS sd, avg(value) AS mean FROM household GROUP BY 1))""",
)
def archetype_rules(spark, d):
    return PR.archetype_rules(T.household(spark, d))


PRESENCE = "pres_frac 6, pres_start_lag 6, pres_end_lead 6, pres_ends_early i, pres_starts_late i, pres_gap_frac 6"
cte(
    "presence",
    """
SELECT entity_id, count(*) / span AS pres_frac, date_diff('day', first, min(date)) / span AS pres_start_lag,
       date_diff('day', max(date), last) / span AS pres_end_lead, date_diff('day', max(date), last) > 14 AS pres_ends_early,
       date_diff('day', first, min(date)) > 14 AS pres_starts_late,
       greatest(1 - count(*) / (date_diff('day', min(date), max(date)) + 1), 0) AS pres_gap_frac
FROM test_rows, (SELECT min(date) AS first, max(date) AS last, date_diff('day', min(date), max(date)) + 1 AS span FROM test_rows)
GROUP BY entity_id, first, last, span""",
)


@register("presence_features", f"entity_id s, date d, {PRESENCE}", "SELECT * FROM test_rows JOIN presence USING (entity_id)")
def presence_features(spark, d):
    return PR.presence_features(T.test_rows(spark, d))


FEASTS = HO.feast_blocks(T.HOLIDAYS.feast)
BLOCKS_SQL = ", ".join(f"({i}, DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(FEASTS))


@register(
    "feast_blocks",
    "date d, block i",
    f"""
SELECT date, dense_rank() OVER (ORDER BY date - CAST(rn AS INTEGER)) - 1 AS block
FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT DISTINCT date FROM panel WHERE date IN ({T.date_list(T.HOLIDAYS.feast)})))""",
)
def feast_blocks(spark, d):
    days = T.panel(spark, d).select("date").distinct()
    block = F.lit(None).cast("int")
    for i, (first, last) in enumerate(FEASTS):
        block = F.when(F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))), i).otherwise(block)
    return days.withColumn("block", block).where("block IS NOT NULL")


cte(
    "feast_own",
    f"""
SELECT entity_id, avg(feast - base) AS dev, sum(n) AS days
FROM (SELECT h.entity_id, b.block, count(*) FILTER (WHERE h.date BETWEEN b.lo AND b.hi) AS n,
             median(log_value) FILTER (WHERE h.date BETWEEN b.lo AND b.hi) AS feast,
             median(log_value) FILTER (WHERE NOT h.date BETWEEN b.lo AND b.hi) AS base
      FROM train h JOIN (VALUES {BLOCKS_SQL}) b(block, lo, hi) ON h.date BETWEEN b.lo - 21 AND b.hi + 21
      GROUP BY 1, 2)
WHERE n >= 2 GROUP BY 1 HAVING avg(feast - base) IS NOT NULL""",
)
cte(
    "feast_cohort",
    """
SELECT district, cap_bucket, (sum(dev) + 5 * (SELECT avg(dev) FROM feast_own)) / (count(*) + 5) AS coh
FROM (SELECT DISTINCT entity_id, district, cap_bucket FROM bucketed) JOIN feast_own USING (entity_id) GROUP BY 1, 2""",
)


@register("feast_deviation", "entity_id s, deviation 6, feast_days 0", "SELECT entity_id, dev AS deviation, days AS feast_days FROM feast_own")
def feast_deviation(spark, d):
    return HO.feast_deviation(T.train(spark, d), T.HOLIDAYS.feast)


@register(
    "feast_response",
    "entity_id s, date d, feast_dev 6",
    f"""
SELECT entity_id, date, CASE WHEN date IN ({T.date_list(T.HOLIDAYS.feast)})
       THEN (coalesce(days, 0) * coalesce(dev, c) + 4 * c) / (coalesce(days, 0) + 4) ELSE 0 END AS feast_dev
FROM (SELECT t.entity_id, t.date, o.dev, o.days, coalesce(f.coh, (SELECT avg(dev) FROM feast_own), 0) AS c
      FROM (SELECT t.*, len(list_filter(edges, lambda e: e <= ln(1 + capacity) + 1e-12)) AS cap_bucket FROM panel t, cap_edges) t
      LEFT JOIN feast_own o ON o.entity_id = t.entity_id
      LEFT JOIN feast_cohort f ON f.district = t.district AND f.cap_bucket = t.cap_bucket)""",
)
def feast_response(spark, d):
    return HO.feast_response(T.panel(spark, d), T.stored_train(spark, d), T.HOLIDAYS.feast)


NO_FEAST = f"date NOT IN ({T.date_list(T.HOLIDAYS.feast_and_eve)})"


@register(
    "clean_month_profiles",
    "profile s, key s, month i, level 6",
    f"""
SELECT 'entity_month' AS profile, entity_id AS key, month, avg(log_value) AS level FROM hist WHERE {NO_FEAST} GROUP BY 1, 2, 3
UNION ALL SELECT 'district_month', district, month, avg(log_value) FROM hist WHERE {NO_FEAST} GROUP BY 1, 2, 3
UNION ALL SELECT 'district_lf_month', district, month, avg(lf) FROM hist WHERE {NO_FEAST} GROUP BY 1, 2, 3""",
)
def clean_month_profiles(spark, d):
    return HO.clean_month_profiles(T.train(spark, d), T.HOLIDAYS.feast_and_eve)


@register(
    "feast_contamination",
    "month i, rows i, feast_rows i, with_feast 6, without_feast 6, bias 6",
    f"""
SELECT month, count(*) AS rows, count(*) FILTER (WHERE NOT {NO_FEAST}) AS feast_rows, avg(log_value) AS with_feast,
       avg(log_value) FILTER (WHERE {NO_FEAST}) AS without_feast, avg(log_value) - avg(log_value) FILTER (WHERE {NO_FEAST}) AS bias
FROM hist WHERE entity_id IN (SELECT entity_id FROM hist GROUP BY 1
                              HAVING avg(log_value) FILTER (WHERE dow < 5) > avg(log_value) FILTER (WHERE dow >= 5))
GROUP BY 1""",
)
def feast_contamination(spark, d):
    return HO.feast_contamination(T.train(spark, d), T.HOLIDAYS.feast_and_eve)


def minimax(cells: str) -> str:
    """Monotone fit as max over starts of min over ends of the weighted mean: independent of pooling."""
    return f"""
SELECT k.region, k.capacity, max(lo) AS fitted
FROM {cells} k JOIN (
  SELECT p.region, p.a, p.k, min(m) AS lo
  FROM (SELECT s.region, s.capacity AS a, k.capacity AS k, e.capacity AS b,
               (SELECT sum(c.n * c.shrunk) / sum(c.n) FROM {cells} c
                WHERE c.region = s.region AND c.capacity BETWEEN s.capacity AND e.capacity) AS m
        FROM {cells} s JOIN {cells} k ON k.region = s.region AND k.capacity >= s.capacity
                       JOIN {cells} e ON e.region = s.region AND e.capacity >= k.capacity) p
  GROUP BY 1, 2, 3) q ON q.region = k.region AND q.k = k.capacity
GROUP BY 1, 2"""


def prior_ctes(prefix: str, source: str, cap: float | None) -> None:
    cte(
        f"{prefix}_cells",
        f"""
SELECT region, capacity, count(*) AS n, any_value(rm) AS region_mean, (sum(log_value) + 5 * any_value(rm)) / (count(*) + 5) AS shrunk
FROM (SELECT *, avg(log_value) OVER (PARTITION BY region) AS rm FROM {source}) GROUP BY 1, 2""",
    )
    cte(f"{prefix}_fit", minimax(f"{prefix}_cells"))
    move = "f.fitted - c.shrunk" if cap is None else f"greatest(-{cap}, least({cap}, f.fitted - c.shrunk))"
    cte(
        f"{prefix}_prior",
        f"""
SELECT c.*, c.shrunk + CASE WHEN count(*) OVER (PARTITION BY c.region) >= 3 THEN {move} ELSE 0 END AS prior
FROM {prefix}_cells c JOIN {prefix}_fit f ON f.region = c.region AND f.capacity = c.capacity""",
    )


prior_ctes("plain", "train", 1.0)
cte(
    "winsor",
    """
SELECT region, capacity, greatest(quantile_cont(log_value, 0.05) OVER w, least(quantile_cont(log_value, 0.95) OVER w, log_value)) AS log_value
FROM train WINDOW w AS (PARTITION BY region, capacity)""",
)
prior_ctes("wins", "winsor", None)
PRIOR = "region s, capacity 1, n i, region_mean 6, shrunk 6, prior 6"


@register("cold_prior", PRIOR, "SELECT * FROM plain_prior")
def cold_prior(spark, d):
    return P.cold_prior(T.train(spark, d))


@register("cold_prior_winsor", PRIOR, "SELECT * FROM wins_prior")
def cold_prior_winsor(spark, d):
    return P.cold_prior_winsor(T.stored_train(spark, d))


cte("iso_cells", "SELECT region, capacity, count(*) AS n, median(log_value) AS shrunk FROM train GROUP BY 1, 2")


@register("isotonic_by_group", "region s, capacity 1, fitted 6", minimax("iso_cells"))
def isotonic_by_group(spark, d):
    rows = T.stored_train(spark, d)
    counts = rows.groupBy("region", "capacity").agg(F.count("*").alias("n"))
    cells = exact_quantiles(rows, ["region", "capacity"], "log_value", {"shrunk": 0.5}).join(counts, ["region", "capacity"])
    return P.isotonic_by_group(cells.select("region", "capacity", "n", "shrunk"), "region", "capacity", "shrunk", "n")


@register(
    "cold_prior_blend",
    "entity_id s, date d, prior 6, pred 6",
    """
SELECT s.entity_id, s.date, coalesce(c.prior, r.rm, (SELECT avg(log_value) FROM winsor)) AS prior,
       CASE WHEN seen THEN pred_a ELSE 0.2e0 * pred_a + 0.8e0 * coalesce(c.prior, r.rm, (SELECT avg(log_value) FROM winsor)) END AS pred
FROM scored s LEFT JOIN wins_prior c ON c.region = s.region AND c.capacity = s.capacity
LEFT JOIN (SELECT region, avg(log_value) AS rm FROM winsor GROUP BY 1) r ON r.region = s.region""",
)
def cold_prior_blend(spark, d):
    past = T.stored_train(spark, d)
    cells = P.cold_prior_winsor(past)
    rows = P.attach_prior(T.scored(spark, d), cells, P.fleet_mean(P.winsorized(past)))
    return rows.withColumn("pred", P.blend_cold(F.col("pred_a"), F.col("prior"), F.col("seen")))


WEATHER_COLUMNS = ("temperature_2m_mean", "cdd22", "cdd_log", "hdd18")


def enriched(spark, d, clean_readings: bool = False):
    rows = staged(T.panel(spark, d))
    wx = weather_basic(T.weather(spark, d, rows)).select("district", "date", *WEATHER_COLUMNS)
    if clean_readings:
        rows = clean.declip(rows).withColumns({"log_value": F.log1p("value"), "is_pos": (F.col("value") > 0).cast("int")})
    return staged(FT.enrich(rows, wx, T.HOLIDAYS))


@register(
    "enrich",
    "entity_id s, date d, month i, dow i, is_holiday i, temperature_2m_mean 6, cdd22 6, hdd18 6",
    f"""
SELECT p.entity_id, p.date, month(p.date) AS month, isodow(p.date) - 1 AS dow,
       (month(p.date) * 100 + day(p.date)) IN (101, 423, 501, 519, 715, 830, 1029) OR p.date IN ({T.date_list(T.HOLIDAYS.feast)}) AS is_holiday,
       w.temperature_2m_mean, w.cdd22, w.hdd18
FROM panel p LEFT JOIN weather_basic w ON w.district = p.district AND w.date = p.date""",
)
def enrich(spark, d):
    return enriched(spark, d)


@register(
    "lag_join",
    "entity_id s, date d, same_day_last_year 6",
    """
SELECT t.entity_id, t.date, h.log_value AS same_day_last_year
FROM test_rows t LEFT JOIN train h ON h.entity_id = t.entity_id AND h.date + 364 = t.date""",
)
def lag_join(spark, d):
    return T.test_rows(spark, d).join(FT.same_day_last_year(T.train(spark, d)), ["entity_id", "date"], "left")


GROUPED = ("ent_mean", "ent_median", "ent_r7_mean", "ent_r28_mean")


def matrix_sql(rows: str, history: str, entity: str, presence: str = "") -> str:
    """The feature matrix, written as one join chain over per-key subqueries."""
    fallback = "gc.m, gd.m"
    group = ", ".join(f"coalesce(e.{c}{', e.ent_mean' if c not in ('ent_mean', 'ent_median') else ''}, {fallback}) AS {c}" for c in GROUPED)
    return f"""
SELECT t.entity_id, t.date, date_diff('day', DATE '{T.CUT}', t.date) AS horizon, {group}, coalesce(e.ent_r91_mean, e.ent_mean) AS ent_r91_mean,
       e.ent_std, e.ent_p10, e.ent_zero_trend, e.ent_slope90, e.ent_cdd_slope, e.ent_hot_delta,
       coalesce(pm.m, e.ent_mean, {fallback}) AS ent_moy_mean, coalesce(pd.m, e.ent_mean, {fallback}) AS ent_dow_mean,
       coalesce(l.log_value, pm.m, e.ent_mean, {fallback}) AS same_day_last_year, CASE WHEN e.ent_mean IS NULL THEN 0 ELSE 1 END AS seen,
       gd.m AS district_mean, gm.m AS district_moy_mean, gk.m AS cap_mean, gk.med AS cap_median, gc.m AS cell_mean, gc.n AS cell_n,
       ln(1 + t.capacity) AS log_capacity, ln(1 + greatest(t.capacity, 1) * 24) AS log_limit,
       ln(1 + coalesce(gm.lf, gd.lf) * greatest(t.capacity, 1) * 24) AS exp_log_district,
       ln(1 + e.ent_lf * greatest(t.capacity, 1) * 24) AS exp_log_entity,
       dd.dist_cdd_slope, dd.dist_trend, dd.dist_r28_zero, pe.peer_mean, pe.peer_n,
       coalesce(e.ent_slope90, 0) * date_diff('day', DATE '{T.CUT}', t.date) AS ent_drift_h,
       coalesce(e.ent_mean, {fallback}) - pe.peer_mean AS ent_vs_peer{presence}
FROM {rows} t
LEFT JOIN ({entity}) e ON e.entity_id = t.entity_id
LEFT JOIN (SELECT entity_id, month, avg(log_value) AS m FROM {history} GROUP BY 1, 2) pm ON pm.entity_id = t.entity_id AND pm.month = month(t.date)
LEFT JOIN (SELECT entity_id, dow, avg(log_value) AS m FROM {history} GROUP BY 1, 2) pd ON pd.entity_id = t.entity_id AND pd.dow = isodow(t.date) - 1
LEFT JOIN {history} l ON l.entity_id = t.entity_id AND l.date = t.date - 364
LEFT JOIN (SELECT district, avg(log_value) AS m, avg(lf) AS lf FROM {history} GROUP BY 1) gd ON gd.district = t.district
LEFT JOIN (SELECT district, month, avg(log_value) AS m, avg(lf) AS lf FROM {history} GROUP BY 1, 2) gm ON gm.district = t.district AND gm.month = month(t.date)
LEFT JOIN (SELECT capacity, avg(log_value) AS m, median(log_value) AS med FROM {history} GROUP BY 1) gk ON gk.capacity = t.capacity
LEFT JOIN (SELECT district, capacity, avg(log_value) AS m, count(*) AS n FROM {history} GROUP BY 1, 2) gc ON gc.district = t.district AND gc.capacity = t.capacity
LEFT JOIN (SELECT district, regr_slope(log_value, cdd22) AS dist_cdd_slope,
                  avg(log_value) FILTER (WHERE age < 28) - avg(log_value) FILTER (WHERE age < 91) AS dist_trend,
                  1 - avg(is_pos) FILTER (WHERE age < 28) AS dist_r28_zero FROM {history} GROUP BY 1) dd ON dd.district = t.district
LEFT JOIN (SELECT district, {EDGE_SQL} AS b, avg(log_value) AS peer_mean, count(*) AS peer_n FROM {history} WHERE age < 91 GROUP BY 1, 2) pe
       ON pe.district = t.district AND pe.b = {EDGE_SQL.replace('capacity', 't.capacity')}"""


MATRIX = (
    "entity_id s, date d, horizon i, ent_mean 6, ent_median 6, ent_r7_mean 6, ent_r28_mean 6, ent_r91_mean 6, ent_std 6, ent_p10 6, "
    "ent_zero_trend 6, ent_slope90 6, ent_cdd_slope 6, ent_hot_delta 6, ent_moy_mean 6, ent_dow_mean 6, same_day_last_year 6, seen i, "
    "district_mean 6, district_moy_mean 6, cap_mean 6, cap_median 6, cell_mean 6, cell_n 0, log_capacity 6, log_limit 6, "
    "exp_log_district 6, exp_log_entity 6, dist_cdd_slope 6, dist_trend 6, dist_r28_zero 6, peer_mean 6, peer_n 0, ent_drift_h 6, ent_vs_peer 6"
)
cte("clean_logged", "SELECT *, ln(1 + value) AS log_value, CASE WHEN value > 0 THEN 1 ELSE 0 END AS is_pos FROM clean_panel")
cte(
    "clean_hist",
    f"""
SELECT t.*, month(t.date) AS month, isodow(t.date) - 1 AS dow, w.temperature_2m_mean, w.cdd22, w.cdd_log,
       t.value / (greatest(t.capacity, 1) * 24) AS lf,
       date_diff('day', t.date, (SELECT max(date) FROM clean_logged WHERE date < DATE '{T.CUT}')) AS age
FROM clean_logged t LEFT JOIN weather_basic w ON w.district = t.district AND w.date = t.date WHERE t.date < DATE '{T.CUT}'""",
)
cte("clean_future", f"SELECT * FROM clean_logged WHERE date >= DATE '{T.CUT}' AND date < DATE '{T.END}'")


@register("attach_features", MATRIX, matrix_sql("test_rows", "hist", "SELECT * FROM entity_history"))
def attach_features(spark, d):
    rows = enriched(spark, d)
    history = H.before_cutoff(rows, T.CUT).where(~F.col("is_new"))
    return FT.attach_features(H.target_window(rows, T.CUT, T.END), history, T.CUT)


INPUTS = [n for n in (c.split()[0] for c in MATRIX.split(",")) if n not in FT.NOT_FEATURES]


@register(
    "feature_list",
    "feature s, present i",
    f"SELECT feature, present FROM (UNPIVOT (SELECT {', '.join(f'count({n}) AS {n}' for n in INPUTS)} FROM ("
    + matrix_sql("test_rows", "hist", "SELECT * FROM entity_history")
    + f")) ON {', '.join(INPUTS)} INTO NAME feature VALUE present)",
)
def feature_list(spark, d):
    """Inputs of the matrix that the check names, and on how many rows each is present."""
    rows = attach_features(spark, d)
    names = [c for c in FT.feature_list(rows) if c in INPUTS]
    counts = rows.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("present")) for c in names])).alias("r")).select("r.*")


@register(
    "snapshot_block",
    f"{MATRIX}, pres_frac 6, pres_gap_frac 6",
    "SELECT * FROM ("
    + matrix_sql("clean_future", "clean_hist", entity_history_sql("clean_hist"))
    + ") JOIN (SELECT entity_id, pres_frac, pres_gap_frac FROM presence) USING (entity_id)",
)
def snapshot_block(spark, d):
    return FT.snapshot_block(enriched(spark, d, clean_readings=True), T.CUT, T.CUT, T.END, presence=True)


BLOCK_CUTS = (
    ("1999-04-01", "1999-04-01", "1999-08-01"),
    ("1999-08-01", "1999-08-01", "1999-12-01"),
    ("1999-12-01", "1999-12-01", "2000-04-01"),
    ("2000-04-01", "2000-04-01", T.END),
)
BLOCK_CASE = "CASE " + " ".join(f"WHEN date >= DATE '{a}' AND date < DATE '{b}' THEN {i}" for i, (_, a, b) in enumerate(BLOCK_CUTS)) + " END"


@register(
    "leakage_audit",
    "block i, first d, last d, rows i, causal i",
    f"""
SELECT block, min(date) AS first, max(date) AS last, count(*) AS rows,
       coalesce(min(date) > max(max(date)) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS causal
FROM (SELECT date, {BLOCK_CASE} AS block FROM panel) WHERE block IS NOT NULL GROUP BY 1""",
)
def leakage_audit(spark, d):
    rows = T.panel(spark, d).select("date", FT.block_number(F.col("date"), BLOCK_CUTS).alias("block"))
    return FT.leakage_audit(rows.where("block IS NOT NULL"))
