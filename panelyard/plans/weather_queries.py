"""Weather columns, hourly series, outages, and dormant entities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelyard.functions import weather as WX
from panelyard.functions.clock import utc_date, utc_instant
from panelyard.operators import external as X
from panelyard.operators import wake as WK
from panelyard.operators import weather_daily as WD
from panelyard.operators.scale import keep_one
from panelyard.plans import tables as T
from panelyard.plans.registry import cte, register
from panelyard.session import shared_dir
from panelyard.sources import panel as SP


@register(
    "weather_basic",
    "district s, date d, hdd18 6, cdd22 6, cdd_log 6, sunshine_hours 6, daylight_hours 6, sunshine_ratio 6, apparent_delta 6, temp_range 6",
    "SELECT * FROM weather_basic",
)
def weather_basic(spark, d):
    return WX.weather_basic(T.weather(spark, d))


@register(
    "weather_physics",
    "district s, date d, dew_point 6, wind_chill 6, heat_index 6, gust_excess 6, temp_humidity 6, temp_wind 6, solar_temp 6, "
    "cloud_humidity 6, rain_sun_opposition 6",
    """
SELECT district, date, 237.7e0 * g / (17.27e0 - g) AS dew_point,
       13.12e0 + 0.6215e0 * t - 11.37e0 * pow(3.6e0 * w, 0.16e0) + 0.3965e0 * t * pow(3.6e0 * w, 0.16e0) AS wind_chill,
       -8.784695e0 + 1.61139411e0 * t + 2.338549e0 * rh - 0.14611605e0 * t * rh - 0.012308094e0 * t * t - 0.016424828e0 * rh * rh
         + 0.002211732e0 * t * t * rh + 0.00072546e0 * t * rh * rh - 0.000003582e0 * t * t * rh * rh AS heat_index,
       wind_gusts_10m_max - w AS gust_excess, t * rh / 100 AS temp_humidity, t * w AS temp_wind, t * shortwave_radiation_sum AS solar_temp,
       cloud_cover_mean * rh AS cloud_humidity, 0 - shortwave_radiation_sum * precipitation_sum AS rain_sun_opposition
FROM (SELECT *, temperature_2m_mean AS t, relative_humidity_2m_mean AS rh, wind_speed_10m_mean AS w,
             17.27e0 * temperature_2m_mean / (237.7e0 + temperature_2m_mean) + ln(greatest(relative_humidity_2m_mean, 1) / 100) AS g FROM weather)""",
)
def weather_physics(spark, d):
    return WX.weather_physics(T.weather(spark, d))


@register(
    "vpd",
    "district s, date d, vpd 6",
    """
SELECT district, date, 0.61078e0 * exp(17.27e0 * temperature_2m_mean / (temperature_2m_mean + 237.3e0)) * (100 - relative_humidity_2m_mean) / 100 AS vpd
FROM weather""",
)
def vpd(spark, d):
    measure = WX.vapour_pressure_deficit(F.col("temperature_2m_mean"), F.col("relative_humidity_2m_mean"))
    return T.weather(spark, d).withColumn("vpd", measure)


ROLLING = (
    "tmean_r7 6, cdd_r7 6, hdd_r7 6, rad_r7 6, vpd_r7 6, cdd_acc 6, heat_wave_3d i, hot_days_7d i, water_deficit_7d 6, "
    "water_deficit_14d 6, water_deficit_30d 6, et0_cum_30d 6, rain_cum_30d 6, soil_moist_anom 6"
)
cte(
    "weather_rolled",
    """
SELECT district, date, precipitation_sum, avg(temperature_2m_mean) OVER w7 AS tmean_r7, avg(cdd22) OVER w7 AS cdd_r7, avg(hdd18) OVER w7 AS hdd_r7,
       avg(shortwave_radiation_sum) OVER w7 AS rad_r7,
       avg(0.61078e0 * exp(17.27e0 * temperature_2m_mean / (temperature_2m_mean + 237.3e0)) * (1 - relative_humidity_2m_mean / 100)) OVER w7 AS vpd_r7,
       sum(cdd22) OVER w14 AS cdd_acc, count(*) FILTER (WHERE temperature_2m_max >= 33) OVER w3 AS heat_wave_3d,
       count(*) FILTER (WHERE temperature_2m_max >= 30) OVER w7 AS hot_days_7d,
       sum(greatest(et0_fao_evapotranspiration - precipitation_sum, 0)) OVER w7 AS water_deficit_7d,
       sum(greatest(et0_fao_evapotranspiration - precipitation_sum, 0)) OVER w14 AS water_deficit_14d,
       sum(greatest(et0_fao_evapotranspiration - precipitation_sum, 0)) OVER w30 AS water_deficit_30d,
       sum(et0_fao_evapotranspiration) OVER w30 AS et0_cum_30d, sum(rain_sum) OVER w30 AS rain_cum_30d,
       sum(rain_sum) OVER w30 - sum(et0_fao_evapotranspiration) OVER w30 AS soil_moist_anom
FROM weather_basic
WINDOW w3 AS (PARTITION BY district ORDER BY date ROWS 2 PRECEDING), w7 AS (PARTITION BY district ORDER BY date ROWS 6 PRECEDING),
       w14 AS (PARTITION BY district ORDER BY date ROWS 13 PRECEDING), w30 AS (PARTITION BY district ORDER BY date ROWS 29 PRECEDING)""",
)
cte(
    "dry_spells",
    """
SELECT district, date, CASE WHEN last_rain IS NULL THEN rn ELSE rn - last_rain END AS days_since_rain
FROM (SELECT *, max(rn) FILTER (WHERE precipitation_sum > 0.5) OVER (PARTITION BY district ORDER BY rn) AS last_rain
      FROM (SELECT district, date, precipitation_sum, row_number() OVER (PARTITION BY district ORDER BY date) AS rn FROM weather))""",
)


@register("weather_rolling", f"district s, date d, {ROLLING}", "SELECT * FROM weather_rolled")
def weather_rolling(spark, d):
    return WD.weather_rolling(WX.weather_basic(T.weather(spark, d)))


@register("days_since_event", "district s, date d, days_since_rain i", "SELECT * FROM dry_spells")
def days_since_event(spark, d):
    return WD.days_since_event(T.weather(spark, d), F.col("precipitation_sum") > 0.5, "days_since_rain")


@register(
    "soil_moisture_anom",
    "district s, date d, soil_moist_anom 6",
    """
SELECT a.district, a.date, sum(b.rain_sum) - sum(b.et0_fao_evapotranspiration) AS soil_moist_anom
FROM weather a JOIN weather b ON b.district = a.district AND b.date BETWEEN a.date - 29 AND a.date GROUP BY 1, 2""",
)
def soil_moisture_anom(spark, d):
    return WD.weather_rolling(WX.weather_basic(T.weather(spark, d)))


@register(
    "read_weather",
    "district s, date d, temperature_2m_mean 6, precipitation_sum 6, dry_spell_len i, vpd_r7 6",
    """
SELECT r.district, r.date, w.temperature_2m_mean, w.precipitation_sum, s.days_since_rain AS dry_spell_len, r.vpd_r7
FROM weather_rolled r JOIN weather w USING (district, date) JOIN dry_spells s USING (district, date)""",
)
def read_weather(spark, d):
    # Written out as a public-style export with its own column names and two extra columns, then read back.
    path = f"{shared_dir(spark)}/weather-{uuid.uuid4().hex}"
    raw = T.weather(spark, d).withColumnsRenamed({"district": "ilce", "date": "tarih"})
    raw.withColumns({"uv_index_max": F.lit(1.0), "uv_index_clear_sky_max": F.lit(2.0)}).write.option("header", True).csv(path)
    return WD.weather_features(SP.read_weather(spark, path))


# The event stream plays a national hourly series: all values summed per clock hour.
cte(
    "load_hours",
    """
SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, round(sum(value) + 1e-7, 2) AS value FROM events GROUP BY 1, 2""",
)


def load_hours(spark, d):
    return T.table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.round(F.sum("value") + 1e-7, 2).alias("value")
    )


@register(
    "hourly_daily_features",
    "date d, load_mean 6, load_max 2, load_min 2, load_range 4, peak_hour i, evening_ratio 6, night_ratio 6, dev_7 6, dev_28 6, yoy 6",
    """
SELECT *, load_mean / avg(load_mean) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) - 1 AS dev_7,
       load_mean / avg(load_mean) OVER (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) - 1 AS dev_28,
       load_mean / lag(load_mean, 364) OVER (ORDER BY date) - 1 AS yoy
FROM (SELECT date, avg(value) AS load_mean, max(value) AS load_max, min(value) AS load_min, max(value) - min(value) AS load_range,
             min(hour) FILTER (WHERE value = top) AS peak_hour, sum(value) FILTER (WHERE hour BETWEEN 18 AND 22) / sum(value) AS evening_ratio,
             sum(value) FILTER (WHERE hour < 6) / sum(value) AS night_ratio
      FROM (SELECT *, max(value) OVER (PARTITION BY date) AS top FROM load_hours) GROUP BY 1)""",
)
def hourly_daily_features(spark, d):
    return X.hourly_daily_features(load_hours(spark, d))


# Daily order totals are long enough for the year-on-year lag: one row per day stands for a daily mean.
@register(
    "trailing_deviation",
    "date d, load_mean 2, dev_7 6, dev_28 6, yoy 6",
    """
SELECT date, load_mean, load_mean / avg(load_mean) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) - 1 AS dev_7,
       load_mean / avg(load_mean) OVER (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) - 1 AS dev_28,
       load_mean / lag(load_mean, 364) OVER (ORDER BY date) - 1 AS yoy
FROM (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS load_mean FROM orders GROUP BY 1)""",
)
def trailing_deviation(spark, d):
    daily = T.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("load_mean"))
    return X.with_trailing(daily, "load_mean")


FUEL_OF = {"view": "gas", "click": "wind", "purchase": "solar", "signup": "dam", "error": "lignite"}
FUEL_COLUMNS = ", ".join(f"sum(value) FILTER (WHERE event_type = '{e}') AS {f}" for e, f in FUEL_OF.items())
cte("fuel_hours", f"SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, sum(value) AS total, {FUEL_COLUMNS} FROM events GROUP BY 1, 2")


def fuel_hours(spark, d):
    parts = [F.sum(F.when(F.col("event_type") == e, F.col("value"))).alias(f) for e, f in FUEL_OF.items()]
    return T.table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.sum("value").alias("total"), *parts
    )


@register(
    "fuel_share_features",
    "date d, plan_total 4, plan_range 4, plan_peak_hour i, sh_gas 6, sh_wind 6, sh_solar 6, sh_hydro 6, sh_geo 6, sh_coal 6, sh_renew 6, dev_7 6, dev_28 6",
    """
SELECT date, total AS plan_total, range AS plan_range, peak AS plan_peak_hour, gas / total AS sh_gas, wind / total AS sh_wind,
       solar / total AS sh_solar, dam / total AS sh_hydro, 0 AS sh_geo, lignite / total AS sh_coal, (wind + solar + dam) / total AS sh_renew,
       total / avg(total) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) - 1 AS dev_7,
       total / avg(total) OVER (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) - 1 AS dev_28
FROM (SELECT date, avg(total) AS total, max(total) - min(total) AS range, arg_max(hour, total) AS peak, coalesce(avg(gas), 0) AS gas,
             coalesce(avg(wind), 0) AS wind, coalesce(avg(solar), 0) AS solar, coalesce(avg(dam), 0) AS dam, coalesce(avg(lignite), 0) AS lignite
      FROM fuel_hours GROUP BY 1)""",
)
def fuel_share_features(spark, d):
    return X.fuel_share_features(fuel_hours(spark, d))


# Errors and sign-ups play unplanned and planned outages: they start when logged and last ten times their
# value in minutes; every seventh has no end yet. Local days are UTC+3.
cte(
    "outage_raw",
    """
SELECT CASE event_type WHEN 'signup' THEN 'planned' ELSE 'unplanned' END AS kind, 'İzmir' AS province,
       'bölge-' || CAST(user_id % 20 AS VARCHAR) AS district, CAST(ts + INTERVAL 3 HOUR AS DATE) AS date, ts AS start_time,
       CASE WHEN event_id % 7 <> 0 THEN ts + to_microseconds(CAST(round(value * 600) AS BIGINT) * 1000000) END AS end_time,
       user_id AS subscribers, value AS hourly_load, event_id AS outage_id
FROM events WHERE event_type IN ('signup', 'error')""",
)


def outage_raw(spark, d):
    events = T.table(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    start = utc_instant(F.col("ts"))
    seconds = F.round(F.col("value") * 600).cast("bigint")
    end = F.timestamp_micros(F.unix_micros(start) + seconds * 1_000_000)
    return events.select(
        F.when(F.col("event_type") == "signup", "planned").otherwise("unplanned").alias("kind"),
        F.lit("İzmir").alias("province"),
        F.concat(F.lit("bölge-"), (F.col("user_id") % 20).cast("string")).alias("district"),
        utc_date(F.timestamp_micros(F.unix_micros(start) + 3 * 3600 * 1_000_000)).alias("date"),
        start.alias("start_time"),
        F.when(F.col("event_id") % 7 != 0, end).alias("end_time"),
        F.col("user_id").alias("subscribers"),
        F.col("value").alias("hourly_load"),
        F.col("event_id").alias("outage_id"),
    )


OUTAGE_COLUMNS = ", ".join(f"outage_{k}_{m} {'i' if m == 'n' else 3}" for k in X.OUTAGE_KINDS for m in X.OUTAGE_METRICS)
OUTAGE_SUMS = ", ".join(
    f"coalesce({e} FILTER (WHERE kind = '{k}'), 0) AS outage_{k}_{m}"
    for k in X.OUTAGE_KINDS
    for m, e in {
        "n": "count(*)", "minutes": "sum(minutes)", "subscribers": "sum(subscribers)", "kwh_lost": "sum(hourly_load * minutes / 60)",
        "sub_minutes": "sum(subscribers * minutes)",
    }.items()
)
cte(
    "outage_days",
    f"""
SELECT province, 'BÖLGE ' || split_part(district, '-', 2) AS district, date, {OUTAGE_SUMS}
FROM (SELECT *, greatest(0, date_diff('microsecond', greatest(start_time, CAST(date AS TIMESTAMP) - INTERVAL 3 HOUR),
             least(coalesce(end_time, CAST(date AS TIMESTAMP) + INTERVAL 21 HOUR), CAST(date AS TIMESTAMP) + INTERVAL 21 HOUR)) / 60e6) AS minutes
      FROM outage_raw) GROUP BY 1, 2, 3""",
)


@register("outage_daily", f"province s, district s, date d, {OUTAGE_COLUMNS}", "SELECT * FROM outage_days")
def outage_daily(spark, d):
    return X.outage_daily(outage_raw(spark, d))


@register(
    "outage_attach",
    "entity_id s, date d, district s, outage_planned_minutes 3, outage_unplanned_n i",
    """
SELECT p.entity_id, p.date, p.district, coalesce(o.outage_planned_minutes, 0) AS outage_planned_minutes, coalesce(o.outage_unplanned_n, 0) AS outage_unplanned_n
FROM (SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(hour AS DATE) AS date, 'BÖLGE ' || CAST(user_id % 25 AS VARCHAR) AS district
      FROM hourly GROUP BY ALL) p
LEFT JOIN outage_days o ON o.district = p.district AND o.date = p.date""",
)
def outage_attach(spark, d):
    # User days with a two- or three-level location; both end in the outage district.
    district = F.concat(F.lit("Bölge "), (F.col("user_id") % 25).cast("string"))
    middle = F.when(F.col("user_id") % 2 == 0, F.lit(" > güney > ")).otherwise(F.lit(">"))
    rows = T.hourly(spark, d).select(
        F.col("user_id").cast("string").alias("entity_id"), F.to_date("hour").alias("date"), F.concat(F.lit("IZMIR"), middle, district).alias("location")
    ).distinct()
    return X.outage_attach(rows, X.outage_daily(outage_raw(spark, d)))


@register(
    "outage_customer_hours",
    "province s, district s, date d, cust_hours 2, cust_affected i, n_outage i, max_dur_h 2",
    """
SELECT o_orderstatus AS province, o_orderpriority AS district, CAST(o_orderdate AS DATE) AS date, round(sum(q + e), 2) AS cust_hours,
       sum(c + s) AS cust_affected, count(*) AS n_outage, max(q) AS max_dur_h
FROM (SELECT l_orderkey, arg_min({q: l_quantity, e: l_extendedprice, c: l_partkey, s: l_suppkey}, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS x
      FROM lineitem GROUP BY 1), LATERAL (SELECT x.q AS q, x.e AS e, x.c AS c, x.s AS s)
JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""",
)
def outage_customer_hours(spark, d):
    line = T.table(spark, d, "lineitem")
    # One line per order plays one outage code; ship date and the other keys decide which line is kept.
    raw = line.join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("code"), F.col("o_orderstatus").alias("province"), F.col("o_orderpriority").alias("district"),
        F.col("o_orderdate").alias("started"), F.col("l_quantity").alias("duration_h"), F.col("l_quantity").alias("hours_low"),
        F.col("l_extendedprice").alias("hours_high"), F.col("l_partkey").alias("customers_a"), F.col("l_suppkey").alias("customers_b"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"),
    )
    first = keep_one(raw, ["code"], F.col("seq")).drop("seq")
    return X.outage_customer_hours(first)


cte(
    "dormant_now",
    f"SELECT entity_id FROM household_past WHERE date >= DATE '{T.CUT}' - 28 GROUP BY 1 HAVING max(value) = 0",
)
cte(
    "dormant_then",
    f"""
SELECT entity_id FROM household_past WHERE date >= DATE '{T.CUT}' - 365 - 28 AND date < DATE '{T.CUT}' - 365 GROUP BY 1 HAVING max(value) = 0""",
)
cte(
    "wake_rows",
    f"""
SELECT * FROM household_past WHERE date >= DATE '{T.CUT}' - 365 AND entity_id IN (SELECT entity_id FROM dormant_then)
UNION ALL SELECT * FROM household_past WHERE entity_id IN (SELECT entity_id FROM dormant_now) AND NOT EXISTS (SELECT 1 FROM dormant_then)""",
)


def wake_scope(name: str, key: str, month: str) -> str:
    return f"""
SELECT '{name}' AS scope, {key} AS key, {month} AS month, count(*) AS n, avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END) AS p,
       coalesce(avg(log_value) FILTER (WHERE value > 0), 0) AS level,
       avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END) * coalesce(avg(log_value) FILTER (WHERE value > 0), 0) AS p_level
FROM wake_rows GROUP BY 1, 2, 3"""


SCOPES = {"entity": ("entity_id", "month"), "district": ("district", "month"), "province": ("province", "month"), "fleet": ("'all'", "0")}
cte("wake_fit", "\nUNION ALL ".join(wake_scope(n, k, m) for n, (k, m) in SCOPES.items()))


@register("seasonal_wake_fit", "scope s, key s, month i, n i, p 6, level 6, p_level 6", "SELECT * FROM wake_fit")
def seasonal_wake_fit(spark, d):
    past, _ = T.household_split(spark, d)
    return WK.seasonal_wake_fit(past, T.CUT)


# Orders are rare, so the gate is lowered; with the default nothing would ever be emitted.
GATE = 0.004


@register(
    "seasonal_wake_apply",
    "entity_id s, date d, wake 6",
    f"""
SELECT f.entity_id, f.date, CASE WHEN f.entity_id IN (SELECT entity_id FROM dormant_now) AND coalesce(di.p, pr.p) >= {GATE}
   THEN greatest(0, least(14, coalesce(en.n / (en.n + 20), 0) * coalesce(en.p_level, 0)
        + (1 - coalesce(en.n / (en.n + 20), 0)) * coalesce(CASE WHEN di.n >= 30 THEN di.p_level END, pr.p_level, fl.p_level))) END AS wake
FROM household_future f
LEFT JOIN wake_fit di ON di.scope = 'district' AND di.key = f.district AND di.month = f.month
LEFT JOIN wake_fit pr ON pr.scope = 'province' AND pr.key = f.province AND pr.month = f.month
LEFT JOIN wake_fit en ON en.scope = 'entity' AND en.key = f.entity_id AND en.month = f.month
LEFT JOIN wake_fit fl ON fl.scope = 'fleet'""",
)
def seasonal_wake_apply(spark, d):
    past, future = T.household_split(spark, d)
    return WK.seasonal_wake_apply(future, past, T.CUT, WK.WakeParams(min_wake_p=GATE))


@register(
    "dormancy_flags",
    "entity_id s, prior_active i",
    f"""
SELECT entity_id, coalesce(max(value) FILTER (WHERE date <= DATE '{T.CUT}' - 28) > 0, FALSE) AS prior_active
FROM household WHERE date <= DATE '{T.CUT}' GROUP BY 1 HAVING max(value) FILTER (WHERE date > DATE '{T.CUT}' - 28) = 0""",
)
def dormancy_flags(spark, d):
    return WK.dormancy_flags(T.household(spark, d), T.CUT)


@register(
    "dormant_floor",
    "entity_id s, date d, pred 6",
    f"""
SELECT f.entity_id, f.date, CASE WHEN g.prior_active IS NOT NULL AND month(f.date) <> 6
       THEN greatest(0.1e0, month(f.date) * CASE WHEN g.prior_active THEN 0.05e0 ELSE 0.01e0 END) ELSE 0.1e0 END AS pred
FROM household_future f LEFT JOIN (
  SELECT entity_id, coalesce(max(value) FILTER (WHERE date <= DATE '{T.CUT}' - 28) > 0, FALSE) AS prior_active
  FROM household WHERE date <= DATE '{T.CUT}' GROUP BY 1 HAVING max(value) FILTER (WHERE date > DATE '{T.CUT}' - 28) = 0) g ON g.entity_id = f.entity_id""",
)
def dormant_floor(spark, d):
    rows = T.household(spark, d)
    future = rows.where(F.col("date") >= F.to_date(F.lit(T.CUT))).withColumns({"seen": F.lit(True), "pred": F.lit(0.1)})
    # Floors per (month, earlier activity); June has none, so its rows keep their prediction.
    grid = [(m, active, m * (0.05 if active else 0.01)) for m in range(1, 13) if m != 6 for active in (True, False)]
    floors = spark.createDataFrame(grid, "month int, prior_active boolean, floor_log double")
    return WK.dormant_floor(future, rows, floors, T.CUT)
