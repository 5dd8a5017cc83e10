"""Panels derived from the shared tables, in Spark and, as the check, in SQL.

readings   supplier x day: capacity-rated meters with a two- or three-level location
weather    district x day: a season plus variation from the day's measured quantity, for the readings' districts
hourly     user x hour totals of the event stream
household  customer x day: zero-filled, mostly dormant
scored     test rows of ``readings`` with three deterministic forecasts in log space
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.calendar import HolidayCalendar
from panelyard.functions.text import parse_location
from panelyard.functions.weather import weather_basic
from panelyard.operators import history as H
from panelyard.operators.evaluate import fold_number
from panelyard.operators.scale import attach, with_totals
from panelyard.plans.registry import cte
from panelyard.session import staged

# The cutoff parts history from what is forecast; nothing after it is left out.
CUT, END = "2000-04-01", "9999-12-31"
RATINGS = (50, 100, 160, 250, 400, 630, 800, 1000, 1250, 1600)
# Suppliers below this account balance got a new meter at the cutoff: from then on their readings are another entity's,
# one without history.
NEW_BALANCE = 1000
# Days with orders and ends of the span that one task expands to the days between them: some millions of days, which
# windows and joins by entity then sort in memory.
MARKS = 1 << 14
FOLDS = (("2000-04-01", "2000-05-01"), ("2000-05-01", "2000-06-15"), ("2000-06-15", END))
HOLIDAYS = HolidayCalendar(
    fixed=((1, 1), (4, 23), (5, 1), (5, 19), (7, 15), (8, 30), (10, 29)),
    ramadan=("1999-01-19", "1999-01-20", "1999-01-21", "2000-01-08", "2000-01-09", "2000-01-10"),
    sacrifice=(
        "1999-03-28", "1999-03-29", "1999-03-30", "1999-03-31", "2000-05-27", "2000-05-28", "2000-05-29", "2000-05-30",
    ),
    eve=("1999-01-18", "1999-03-27", "2000-01-07", "2000-05-26"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def date_list(days) -> str:
    """SQL IN-list of dates."""
    return ", ".join(f"DATE '{d}'" for d in days)


RATING_ARRAY = ", ".join(str(r) for r in RATINGS)

cte(
    "readings",
    f"""
SELECT 'TR-' || lpad(CAST(s.s_suppkey AS VARCHAR), 6, '0') || CASE WHEN s.s_acctbal < {NEW_BALANCE} AND d.date >= DATE '{CUT}' THEN '-B' ELSE '' END AS entity_id,
       d.date, d.value,
       CAST(([{RATING_ARRAY}])[1 + s.s_suppkey % 10] AS DOUBLE) AS capacity,
       r.r_name || ' > ' || n.n_name || CASE WHEN r.r_regionkey % 2 = 1
            THEN ' > ' || n.n_name || '-Z' || CAST(s.s_suppkey % 3 AS VARCHAR) ELSE '' END AS location,
       CAST(n.n_nationkey * 4 + CASE WHEN r.r_regionkey % 2 = 1 THEN 1 + s.s_suppkey % 3 ELSE 0 END AS INTEGER) AS district_no,
       s.s_acctbal < {NEW_BALANCE} AND d.date >= DATE '{CUT}' AS is_new
FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date,
             round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice * (1 - l_discount) END) / 50 + 1e-7, 2) AS value
      FROM lineitem GROUP BY 1, 2) d
JOIN supplier s ON s.s_suppkey = d.l_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey""",
)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    # Reduce before joining: only one row per supplier and day meets the dimensions. Returned goods count as nothing
    # used, so the panel has true zero days.
    used = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    daily = line.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum(used) / 50 + 1e-7, 2).alias("value"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    who = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    zoned = F.col("r_regionkey") % 2 == 1
    zone = F.concat(F.lit(" > "), F.col("n_name"), F.lit("-Z"), (key % 3).cast("string"))
    ratings = F.array(*[F.lit(float(r)) for r in RATINGS])
    meters = who.select(
        key,
        F.concat(F.lit("TR-"), F.lpad(key.cast("string"), 6, "0")).alias("entity_id"),
        F.get(ratings, (key % 10).cast("int")).alias("capacity"),
        F.concat("r_name", F.lit(" > "), "n_name", F.when(zoned, zone).otherwise(F.lit(""))).alias("location"),
        (F.col("n_nationkey") * 4 + F.when(zoned, 1 + key % 3).otherwise(0)).cast("int").alias("district_no"),
        (F.col("s_acctbal") < NEW_BALANCE).alias("_renewed"),
    )
    is_new = F.col("_renewed") & (F.col("date") >= F.to_date(F.lit(CUT)))
    entity = F.concat("entity_id", F.when(is_new, F.lit("-B")).otherwise(F.lit("")))
    return daily.join(meters, F.col("l_suppkey") == key).select(
        entity.alias("entity_id"), "date", "value", "capacity", "location", "district_no", is_new.alias("is_new")
    )


cte(
    "panel",
    """
SELECT entity_id, date, value, capacity, location, district_no, is_new,
       trim(p[1]) AS province,
       CASE WHEN len(p) >= 3 THEN trim(p[2]) ELSE trim(p[1]) END AS region,
       coalesce(trim(p[3]), trim(p[2]), trim(p[1])) AS district,
       ln(1 + value) AS log_value, CASE WHEN value > 0 THEN 1 ELSE 0 END AS is_pos
FROM (SELECT *, string_split(location, '>') AS p FROM readings)""",
)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_location(readings(spark, sf_dir)).withColumns(
        {"log_value": F.log1p("value"), "is_pos": (F.col("value") > 0).cast("int")}
    )


cte("train", f"SELECT * FROM panel WHERE date < DATE '{CUT}' AND NOT is_new")
cte("test_rows", f"SELECT * FROM panel WHERE date >= DATE '{CUT}' AND date < DATE '{END}'")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.before_cutoff(panel(spark, sf_dir), CUT).where(~F.col("is_new"))


def stored_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stored table, for queries that read them more than once."""
    return staged(train(spark, sf_dir))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.target_window(panel(spark, sf_dir), CUT, END)


WAVE = "cos(2e0 * pi() * (doy - 15) / 365.25e0)"
DAYLIGHT = f"(43200e0 - 10800e0 * {WAVE})"
# One text per measure, valid in both engines: means, extremes and shares of the day's order lines of a district, brought
# into the range of the weather column that they stand for. Only the length of the day follows the calendar.
WEATHER_MEASURES = {
    "temperature_2m_mean": "0.8e0 * quantity - 6e0",
    "temperature_2m_min": "0.8e0 * least - 8e0",
    "temperature_2m_max": "0.8e0 * most - 4e0",
    "apparent_temperature_mean": "0.8e0 * quantity - 6e0 + 60e0 * (discount - 0.05e0)",
    "relative_humidity_2m_mean": "35e0 + 700e0 * tax",
    "precipitation_sum": "greatest(400e0 * (discount - 0.05e0), 0e0)",
    "rain_sum": "greatest(360e0 * (discount - 0.05e0), 0e0)",
    "cloud_cover_mean": "1000e0 * discount",
    "wind_speed_10m_mean": "1e0 + number",
    "wind_speed_10m_max": "3e0 + number + 40e0 * tax",
    "wind_gusts_10m_max": "3e0 + number + 100e0 * tax",
    "surface_pressure_mean": "1000e0 + 20e0 * returned",
    "shortwave_radiation_sum": "0.4e0 * quantity + 50e0 * tax",
    "sunshine_duration": f"{DAYLIGHT} * (0.9e0 - 6e0 * discount)",
    "daylight_duration": DAYLIGHT,
    "et0_fao_evapotranspiration": "0.1e0 * quantity + 20e0 * tax",
}
# Sums of whole numbers, so that both engines divide the same two integers.
LINE_SUMS = {
    "lines": "count(*)", "quantity": "sum(CAST(l_quantity AS BIGINT))", "discount": "sum(CAST(round(l_discount * 100) AS BIGINT))",
    "tax": "sum(CAST(round(l_tax * 100) AS BIGINT))", "number": "sum(CAST(l_linenumber AS BIGINT))",
    "returned": "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", "least": "min(CAST(l_quantity AS BIGINT))", "most": "max(CAST(l_quantity AS BIGINT))",
}
LINE_MEANS = {
    "quantity": "quantity / CAST(lines AS DOUBLE)", "discount": "discount / CAST(lines AS DOUBLE) / 100e0", "tax": "tax / CAST(lines AS DOUBLE) / 100e0",
    "number": "number / CAST(lines AS DOUBLE)", "returned": "returned / CAST(lines AS DOUBLE)", "least": "CAST(least AS DOUBLE)", "most": "CAST(most AS DOUBLE)",
}
_SUMS = ", ".join(f"{e} AS {n}" for n, e in LINE_SUMS.items())
_MEANS = ", ".join(f"{e} AS {n}" for n, e in LINE_MEANS.items())
cte(
    "line_places",
    """
SELECT l.*, CAST(l_shipdate AS DATE) AS date, p.district FROM lineitem l
JOIN (SELECT DISTINCT CAST(substr(entity_id, 4, 6) AS BIGINT) AS s, district FROM panel) p ON p.s = l.l_suppkey""",
)
cte(
    "weather_days",
    f"""
SELECT s.district, s.date, CAST(dayofyear(s.date) AS INTEGER) AS doy, {", ".join(f"coalesce(m.{n}, y.{n}, e.{n}) AS {n}" for n in LINE_MEANS)}
FROM (SELECT district, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT district, min(date) AS first, max(date) AS last FROM panel GROUP BY 1)) s
LEFT JOIN (SELECT district, date, {_MEANS} FROM (SELECT district, date, {_SUMS} FROM line_places GROUP BY 1, 2)) m ON m.district = s.district AND m.date = s.date
LEFT JOIN (SELECT date, {_MEANS} FROM (SELECT date, {_SUMS} FROM line_places GROUP BY 1)) y ON y.date = s.date
CROSS JOIN (SELECT {_MEANS} FROM (SELECT {_SUMS} FROM line_places)) e""",
)
cte("weather", "SELECT district, date, " + ", ".join(f"{e} AS {n}" for n, e in WEATHER_MEASURES.items()) + " FROM weather_days")


def weather(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One row per district and day of its span: the district's lines of the day, else all lines of the day, else all lines.

    ``rows``: the panel where it is stored already; its readings are passed once.
    """
    rows = panel(spark, sf_dir) if rows is None else rows
    ends = F.min("date").alias("first"), F.max("date").alias("last")
    meters = staged(rows.groupBy(F.substring("entity_id", 4, 6).cast("long").alias("_s"), "district").agg(*ends))
    spans = meters.groupBy("district").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spread = spans.select("district", F.explode(F.sequence("first", "last")).alias("date"))
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    # one row per supplier and day first, then the place of the supplier: the lines themselves are never joined
    totals = {n: F.max(n) if n == "most" else F.min(n) if n == "least" else F.sum(n) for n in LINE_SUMS}
    sums = lambda df, *keys: df.groupBy(*keys).agg(*[e.alias(n) for n, e in totals.items()])
    daily = lines.groupBy("l_suppkey", "date").agg(*[F.expr(e).alias(n) for n, e in LINE_SUMS.items()])
    places = meters.select("_s", "district")
    cells = staged(sums(daily.join(places, F.col("l_suppkey") == F.col("_s")), "district", "date"))

    def means(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*[c for c in df.columns if c not in LINE_SUMS], *[F.expr(e).alias(f"{n}{mark}") for n, e in LINE_MEANS.items()])

    days = spread.join(means(cells, "_m"), ["district", "date"], "left").join(means(sums(cells, "date"), "_y"), "date", "left")
    days = with_totals(days, means(sums(cells), "_e")).withColumn("doy", F.dayofyear("date"))
    days = days.withColumns({n: F.coalesce(f"{n}_m", f"{n}_y", f"{n}_e") for n in LINE_MEANS})
    return days.select("district", "date", *[F.expr(e).alias(n) for n, e in WEATHER_MEASURES.items()])


cte(
    "weather_basic",
    """
SELECT *, greatest(18 - temperature_2m_mean, 0) AS hdd18, greatest(temperature_2m_mean - 22, 0) AS cdd22,
       ln(1 + greatest(temperature_2m_mean - 22, 0)) AS cdd_log,
       sunshine_duration / 3600 AS sunshine_hours, daylight_duration / 3600 AS daylight_hours,
       sunshine_duration / nullif(daylight_duration, 0) AS sunshine_ratio,
       apparent_temperature_mean - temperature_2m_mean AS apparent_delta,
       temperature_2m_max - temperature_2m_min AS temp_range
FROM weather""",
)
cte(
    "hist",
    """
SELECT t.*, month(t.date) AS month, isodow(t.date) - 1 AS dow, w.temperature_2m_mean, w.cdd22, w.cdd_log, w.hdd18,
       t.value / (greatest(t.capacity, 1) * 24) AS lf,
       date_diff('day', t.date, (SELECT max(date) FROM train)) AS age
FROM train t LEFT JOIN weather_basic w ON w.district = t.district AND w.date = t.date""",
)


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with the weather columns the history operators use."""
    wx = weather_basic(weather(spark, sf_dir)).select(
        "district", "date", "temperature_2m_mean", "cdd22", "cdd_log", "hdd18"
    )
    return staged(train(spark, sf_dir).join(wx, ["district", "date"], "left"))


cte(
    "hourly",
    """
SELECT user_id, date_trunc('hour', ts) AS hour, round(sum(value) + 1e-7, 2) AS value
FROM events GROUP BY 1, 2""",
)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.round(F.sum("value") + 1e-7, 2).alias("value")
    )


cte("order_span", "SELECT min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders")
cte(
    "household",
    f"""
SELECT c.entity_id, c.date, coalesce(o.value, 0) AS value, c.capacity, c.province, c.region, c.district,
       ln(1 + coalesce(o.value, 0)) AS log_value, CASE WHEN coalesce(o.value, 0) > 0 THEN 1 ELSE 0 END AS is_pos
FROM (SELECT c_custkey, 'HH-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS entity_id,
             CAST(unnest(generate_series((SELECT first FROM order_span), (SELECT last FROM order_span), INTERVAL 1 DAY)) AS DATE) AS date,
             CAST(([{RATING_ARRAY}])[1 + c_custkey % 10] AS DOUBLE) AS capacity,
             r_name AS province, r_name AS region, n_name AS district
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) c
LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice) / 100 + 1e-7, 2) AS value
           FROM orders GROUP BY 1, 2) o ON o.o_custkey = c.c_custkey AND o.date = c.date""",
)
cte("household_past", f"SELECT *, month(date) AS month FROM household WHERE date < DATE '{CUT}'", materialized=True)
cte("household_future", f"SELECT *, month(date) AS month FROM household WHERE date >= DATE '{CUT}'", materialized=True)


def household(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    ratings = F.array(*[F.lit(float(r)) for r in RATINGS])
    day = F.to_date("o_orderdate")
    # The calendar runs from the first order of the table to its last: one row, two scalar subqueries.
    first, end = orders.agg(F.min(day)).scalar(), F.date_add(orders.agg(F.max(day)).scalar(), 1)
    homes = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("_key"),
        F.concat(F.lit("HH-"), F.lpad(key.cast("string"), 7, "0")).alias("entity_id"),
        F.get(ratings, (key % 10).cast("int")).alias("capacity"),
        F.col("r_name").alias("province"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("district"),
    )
    bought = orders.groupBy(F.col("o_custkey").alias("_key"), day.alias("_day")).agg(
        F.round(F.sum("o_totalprice") / 100 + 1e-7, 2).alias("_v")
    )
    # Zero days are the gaps between marks (days with orders, and both ends of the span), so only marks are
    # shuffled and every gap is expanded where its mark is. The expansion is several hundredfold, hence the
    # explicit number of partitions before it, which grows with the marks (counts of stored tables read no rows). They are
    # dealt by entity, so windows and aggregates by entity move no expanded day.
    ends = homes.select("_key", F.explode(F.array(F.date_sub(first, 1), end)).alias("_day"))
    marks = ends.withColumn("_v", F.lit(None).cast("double")).unionByName(bought).join(homes, "_key")
    tasks = max(2 * spark.sparkContext.defaultParallelism, (2 * customer.count() + orders.count()) // MARKS)
    spread = marks.repartition(tasks, "entity_id")
    following = F.lead("_day").over(Window.partitionBy("entity_id", "_key").orderBy("_day"))
    gaps = spread.withColumn("_next", following).where("_next IS NOT NULL")
    days = gaps.withColumn("date", F.explode(F.sequence("_day", F.date_sub("_next", 1)))).where(F.col("date") >= first)
    value = F.when(F.col("date") == F.col("_day"), F.coalesce("_v", F.lit(0.0))).otherwise(F.lit(0.0))
    return days.select("entity_id", "date", value.alias("value"), "capacity", "province", "region", "district").withColumns(
        {"log_value": F.log1p("value"), "is_pos": (F.col("value") > 0).cast("int")}
    )


def household_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before the cutoff, from it on)."""
    rows = household(spark, sf_dir)
    cut = F.to_date(F.lit(CUT))
    return rows.where(F.col("date") < cut), rows.where(F.col("date") >= cut)


FOLD_CASE = "CASE " + " ".join(f"WHEN t.date >= DATE '{a}' AND t.date < DATE '{b}' THEN '{a}'" for a, b in FOLDS) + " END"
cte(
    "scored",
    f"""
SELECT t.entity_id, t.date, t.province, t.region, t.district, t.capacity, t.location, t.value, t.log_value AS y,
       e.m IS NOT NULL AS seen, date_diff('day', DATE '{CUT}', t.date) AS horizon, {FOLD_CASE} AS fold,
       coalesce(e.m, f.m) AS pred_a,
       coalesce(e.m, f.m) + 0.15e0 * sin(date_diff('day', DATE '{CUT}', t.date) / 10e0) AS pred_b,
       0.8e0 * coalesce(e.m, f.m) + 0.2e0 * coalesce(d.m, f.m) AS pred_c
FROM test_rows t
LEFT JOIN (SELECT entity_id, avg(log_value) AS m FROM train GROUP BY 1) e ON e.entity_id = t.entity_id
LEFT JOIN (SELECT district, avg(log_value) AS m FROM train GROUP BY 1) d ON d.district = t.district
CROSS JOIN (SELECT avg(log_value) AS m FROM train) f""",
)
cte(
    "forecasts",
    """
SELECT entity_id, date, province, region, district, capacity, location, seen, v.version, v.log_pred,
       greatest(exp(v.log_pred) - 1, 0) AS pred
FROM scored, LATERAL (VALUES ('v1', pred_a), ('v2', pred_b), ('v3', pred_c)) v(version, log_pred)""",
)
VERSIONS = ("v1", "v2", "v3")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = stored_train(spark, sf_dir)
    own = past.groupBy("entity_id").agg(F.avg("log_value").alias("_e"))
    place = past.groupBy("district").agg(F.avg("log_value").alias("_d"))
    fleet = past.agg(F.avg("log_value").alias("_f"))
    rows = test_rows(spark, sf_dir).drop("is_new", "district_no").join(own, "entity_id", "left")
    rows = with_totals(attach(rows, place, "district"), fleet)
    level = F.coalesce("_e", "_f")
    horizon = F.datediff("date", F.to_date(F.lit(CUT)))
    return rows.withColumns(
        {
            "y": F.col("log_value"),
            "seen": F.col("_e").isNotNull(),
            "horizon": horizon,
            "fold": fold_number(F.col("date"), FOLDS),
            "pred_a": level,
            "pred_b": level + 0.15 * F.sin(horizon / 10),
            "pred_c": 0.8 * level + 0.2 * F.coalesce("_d", "_f"),
        }
    ).drop("_e", "_d", "_f", "log_value", "is_pos").transform(staged)


def forecasts(spark: SparkSession, sf_dir: str, wanted: Sequence[str] = VERSIONS) -> DataFrame:
    """Rows per version; only the ``wanted`` versions' columns are unfolded."""
    columns = dict(zip(VERSIONS, ("pred_a", "pred_b", "pred_c"), strict=True))
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(columns[v]).alias("log_pred")) for v in wanted]))
    rows = scored(spark, sf_dir).withColumn("_v", versions).select("*", "_v.*")
    return rows.withColumn("pred", F.greatest(F.expm1("log_pred"), F.lit(0.0))).select(
        "entity_id", "date", "province", "region", "district", "capacity", "location", "seen", "version", "log_pred", "pred"
    )


cte("served_weather", "SELECT district, date, round(temperature_2m_mean + 1e-7, 2) AS temp_mean FROM weather")


def served_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather(spark, sf_dir).select("district", "date", F.round(F.col("temperature_2m_mean") + 1e-7, 2).alias("temp_mean"))
