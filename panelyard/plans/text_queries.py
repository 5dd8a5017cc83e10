"""Scalar functions: locale text, calendar, capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions import calendar as C
from panelyard.functions import capacity as K
from panelyard.functions import text as X
from panelyard.operators import evaluate as E
from panelyard.operators import groups as G
from panelyard.plans import tables as T
from panelyard.plans.registry import cte, register


@register(
    "parse_location",
    "entity_id s, location s, province s, region s, district s, levels i",
    """
SELECT DISTINCT entity_id, location, trim(split_part(location, '>', 1)) AS province,
       CASE WHEN location LIKE '%>%>%' THEN trim(split_part(location, '>', 2)) ELSE trim(split_part(location, '>', 1)) END AS region,
       regexp_extract(location, '([^>]*)$', 1).trim() AS district,
       length(location) - length(replace(location, '>', '')) + 1 AS levels
FROM readings""",
)
def parse_location(spark, d):
    places = T.readings(spark, d).select("entity_id", "location").distinct()
    return X.parse_location(places).withColumn("levels", F.size(X.location_levels(F.col("location"))))


# Local numerals and dates are written out from order rows; pending orders carry unreadable text instead.
def order_text(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.floor(cents / 100)
    thousands = F.floor(whole / 1000)
    head = F.concat(thousands.cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))
    number = F.concat(F.when(thousands > 0, head).otherwise(whole.cast("string")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    bad = F.col("o_orderstatus") == "P"
    priority = F.col("o_orderpriority")
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    stamp = F.when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit(" 00:00"))).otherwise(day)
    return T.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(bad, priority).otherwise(number).alias("number_text"),
        F.when(bad, priority).otherwise(stamp).alias("date_text"),
        F.when(bad, priority)
        .when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M.yyyy"))
        .otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
        .alias("period_text"),
    )


@register(
    "tr_number",
    "o_orderkey i, parsed 2",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS parsed FROM orders",
)
def tr_number(spark, d):
    return order_text(spark, d).select("o_orderkey", X.tr_number(F.col("number_text")).alias("parsed"))


@register(
    "tr_date",
    "o_orderkey i, parsed d",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders",
)
def tr_date(spark, d):
    return order_text(spark, d).select("o_orderkey", X.tr_date(F.col("date_text")).alias("parsed"))


@register(
    "period_norm",
    "o_orderkey i, period s",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN trim(o_orderpriority) ELSE strftime(o_orderdate, '%Y-%m') END AS period
FROM orders""",
)
def period_norm(spark, d):
    return order_text(spark, d).select("o_orderkey", X.period_norm(F.col("period_text")).alias("period"))


@register(
    "deaccent",
    "n_nationkey i, plain s",
    "SELECT n_nationkey, strip_accents(replace(n_name || ' ığİçöşü ÇĞÖŞÜ', 'ı', 'i')) AS plain FROM nation",
)
def deaccent(spark, d):
    return T.table(spark, d, "nation").select("n_nationkey", X.deaccent(F.concat("n_name", F.lit(" ığİçöşü ÇĞÖŞÜ"))).alias("plain"))


@register(
    "norm_place",
    "c_custkey i, upper_tr s, place s, plain s",
    """
SELECT c_custkey, upper(replace(replace(replace(raw, 'ı', 'i'), 'I', 'i'), 'i', 'İ')) AS upper_tr,
       trim(regexp_replace(regexp_replace(upper(replace(replace(replace(raw, 'ı', 'i'), 'I', 'i'), 'i', 'İ')),
            '[^\\p{L}\\p{N}_ ]', ' ', 'g'), '\\s+', ' ', 'g')) AS place,
       strip_accents(replace(raw, 'ı', 'i')) AS plain
FROM (SELECT c_custkey, c_mktsegment || ' -  ığİçöşü/' || lower(c_mktsegment) || '#' || c_name AS raw FROM customer)""",
)
def norm_place(spark, d):
    raw = F.concat("c_mktsegment", F.lit(" -  ığİçöşü/"), F.lower("c_mktsegment"), F.lit("#"), "c_name")
    rows = T.table(spark, d, "customer").withColumn("raw", raw)
    return rows.select(
        "c_custkey", X.tr_upper(F.col("raw")).alias("upper_tr"), X.norm_place(F.col("raw")).alias("place"), X.deaccent(F.col("raw")).alias("plain")
    )


@register(
    "day_label",
    "o_orderkey i, label s",
    "SELECT o_orderkey, strftime(o_orderdate, '%d-%m (') || lower(strftime(o_orderdate, '%a')) || ')' AS label FROM orders",
)
def day_label(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", X.day_label(F.to_date("o_orderdate")).alias("label"))


@register("numeric_id", "s_name s, num_id i", "SELECT s_name, s_suppkey AS num_id FROM supplier")
def numeric_id(spark, d):
    return T.table(spark, d, "supplier").select("s_name", X.numeric_id(F.col("s_name")).alias("num_id"))


FIXED = ", ".join(str(m * 100 + dd) for m, dd in T.HOLIDAYS.fixed)


@register(
    "calendar_features",
    "date d, month i, dow i, doy i, is_weekend i, doy_sin 6, doy_cos 6, month_sin 6, month_cos 6, dow_sin 6, dow_cos 6, "
    "is_holiday i, is_ramadan_feast i, is_sacrifice_feast i, is_eve i, is_school_holiday i, days_into_summer_break i",
    f"""
SELECT date, month(date) AS month, isodow(date) - 1 AS dow, dayofyear(date) AS doy, isodow(date) >= 6 AS is_weekend,
       sin(2 * pi() * dayofyear(date) / 365.25e0) AS doy_sin, cos(2 * pi() * dayofyear(date) / 365.25e0) AS doy_cos,
       sin(2 * pi() * month(date) / 12e0) AS month_sin, cos(2 * pi() * month(date) / 12e0) AS month_cos,
       sin(2 * pi() * (isodow(date) - 1) / 7e0) AS dow_sin, cos(2 * pi() * (isodow(date) - 1) / 7e0) AS dow_cos,
       (month(date) * 100 + day(date)) IN ({FIXED}) OR date IN ({T.date_list(T.HOLIDAYS.feast)}) AS is_holiday,
       date IN ({T.date_list(T.HOLIDAYS.ramadan)}) AS is_ramadan_feast,
       date IN ({T.date_list(T.HOLIDAYS.sacrifice)}) AS is_sacrifice_feast,
       date IN ({T.date_list(T.HOLIDAYS.eve)}) AS is_eve,
       dayofyear(date) BETWEEN 166 AND 258 AS is_school_holiday,
       CASE WHEN dayofyear(date) BETWEEN 166 AND 258 THEN dayofyear(date) - 166 ELSE 0 END AS days_into_summer_break
FROM (SELECT DISTINCT date FROM readings)""",
)
def calendar_features(spark, d):
    return C.calendar_features(T.readings(spark, d).select("date").distinct(), T.HOLIDAYS)


@register(
    "calendar_extra",
    "date d, year i, quarter i, day_of_month i, season i, is_month_start i, is_month_end i, is_quarter_start i, "
    "is_quarter_end i, is_year_start i, is_year_end i",
    """
SELECT date, year(date) AS year, quarter(date) AS quarter, day(date) AS day_of_month,
       CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) <= 5 THEN 1 WHEN month(date) <= 8 THEN 2 ELSE 3 END AS season,
       day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end,
       day(date) = 1 AND month(date) IN (1, 4, 7, 10) AS is_quarter_start,
       date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS is_quarter_end,
       strftime(date, '%m%d') = '0101' AS is_year_start, strftime(date, '%m%d') = '1231' AS is_year_end
FROM (SELECT DISTINCT date FROM readings)""",
)
def calendar_extra(spark, d):
    return C.calendar_extra(T.readings(spark, d).select("date").distinct())


def spline_sql(x: str, low: int, high: int, name: str) -> str:
    u = f"(({x} - {low}) / {high - low}e0)"
    return f"pow(1 - {u}, 2) / 2 AS {name}_sp_0, 0.5 + {u} * (1 - {u}) AS {name}_sp_1, pow({u}, 2) / 2 AS {name}_sp_2"


@register(
    "spline_features",
    "date d, " + ", ".join(f"{p}_sp_{i} 6" for p in ("doy", "dom", "dow") for i in range(3)),
    f"""
SELECT date, {spline_sql('dayofyear(date)', 1, 366, 'doy')}, {spline_sql('day(date)', 1, 31, 'dom')},
       {spline_sql('(isodow(date) - 1)', 0, 6, 'dow')}
FROM (SELECT DISTINCT date FROM readings)""",
)
def spline_features(spark, d):
    return C.spline_features(T.readings(spark, d).select("date").distinct())


EDGE_SQL = "CASE " + " ".join(
    f"WHEN capacity > {a} AND capacity <= {b} THEN {i}" for i, (a, b) in enumerate(zip(K.CAPACITY_EDGES, K.CAPACITY_EDGES[1:]))
) + " END"


@register(
    "capacity_bucket_fixed",
    "entity_id s, bucket i",
    f"SELECT DISTINCT entity_id, {EDGE_SQL} AS bucket FROM readings",
)
def capacity_bucket_fixed(spark, d):
    rows = T.readings(spark, d).select("entity_id", "capacity").distinct()
    return rows.select("entity_id", K.capacity_bucket_fixed(F.col("capacity")).alias("bucket"))


cte(
    "cap_edges",
    """
SELECT list_sort(list_distinct(quantile_cont(ln(1 + capacity), [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS edges
FROM train""",
)


@register(
    "capacity_bucket_quantile",
    "entity_id s, bucket i",
    """
SELECT DISTINCT entity_id, len(list_filter(edges, lambda e: e <= ln(1 + capacity) + 1e-12)) AS bucket
FROM panel, cap_edges""",
)
def capacity_bucket_quantile(spark, d):
    edges = G.capacity_edges(T.stored_train(spark, d))
    rows = T.panel(spark, d).select("entity_id", "capacity").distinct()
    return G.with_capacity_bucket(rows, edges, "bucket")


@register(
    "capacity_anchors",
    "entity_id s, log_capacity 6, log_limit 6, load_factor 6",
    """
SELECT entity_id, ln(1 + max(capacity)) AS log_capacity, ln(1 + greatest(max(capacity), 1) * 24) AS log_limit,
       avg(value / (greatest(capacity, 1) * 24)) AS load_factor
FROM train GROUP BY 1""",
)
def capacity_anchors(spark, d):
    cap = F.col("capacity")
    rows = T.train(spark, d).groupBy("entity_id").agg(
        F.max(cap).alias("capacity"), F.avg(K.load_factor(F.col("value"), cap)).alias("load_factor")
    )
    return rows.withColumns({"log_capacity": F.log1p("capacity"), "log_limit": F.log1p(K.daily_limit(cap))})


@register(
    "horizon",
    "entity_id s, date d, horizon i",
    f"SELECT entity_id, date, date_diff('day', DATE '{T.CUT}', date) AS horizon FROM test_rows",
)
def horizon(spark, d):
    return T.test_rows(spark, d).withColumn("horizon", F.datediff("date", F.to_date(F.lit(T.CUT))))


@register(
    "forecast_invert",
    "entity_id s, date d, value 4",
    "SELECT entity_id, date, CASE WHEN pred_b - 6 < 0 THEN 0 ELSE exp(pred_b - 6) - 1 END AS value FROM scored",
)
def forecast_invert(spark, d):
    rows = T.scored(spark, d)
    return rows.select("entity_id", "date", K.forecast_invert(F.col("pred_b") - 6).alias("value"))


@register(
    "hurdle_dampen",
    "entity_id s, date d, pred 6",
    """
SELECT entity_id, date, CASE WHEN seen AND p < 0.9e0 THEN ln(1 + (exp(pred_a) - 1) * sqrt(p)) ELSE pred_a END AS pred
FROM (SELECT *, (horizon % 100) / 100e0 AS p FROM scored)""",
)
def hurdle_dampen(spark, d):
    rows = T.scored(spark, d).withColumns({"p_active": (F.col("horizon") % 100) / 100, "pred": F.col("pred_a")})
    return E.apply_hurdle(rows)


@register(
    "segment_shift",
    "entity_id s, date d, pred 6",
    """
SELECT entity_id, date, greatest(pred_a + CASE WHEN n % 2 = 0 THEN 0.25e0 ELSE -20e0 END, 0) AS pred
FROM scored JOIN (SELECT district, count(*) AS n FROM train GROUP BY 1) USING (district)
UNION ALL
SELECT entity_id, date, greatest(pred_a, 0) FROM scored WHERE district NOT IN (SELECT district FROM train)""",
)
def segment_shift(spark, d):
    counts = T.train(spark, d).groupBy("district").agg(F.count("*").alias("n"))
    shifts = counts.select("district", F.when(F.col("n") % 2 == 0, 0.25).otherwise(-20.0).alias("shift"))
    return E.shift_segments(T.scored(spark, d).withColumn("pred", F.col("pred_a")), shifts, ["district"])
