import datetime as dt

import pytest
from helpers import day, records, series

from panelyard.operators import external as X
from panelyard.operators import weather_daily as WD
from panelyard.functions import calendar as C
from panelyard.functions import weather as WX
from pyspark.sql import functions as F
from helpers import days

RAW = (
    "kind string, province string, date date, district string, start_time timestamp, end_time timestamp, subscribers int, "
    "hourly_load double, outage_id int"
)


def outages(spark):
    def at(text):
        return dt.datetime.fromisoformat(text + "+03:00").astimezone(dt.timezone.utc).replace(tzinfo=None)

    return series(
        spark,
        [
            ("planned", "İzmir", day("2025-05-01"), "Foça", at("2025-05-01T10:00"), at("2025-05-01T11:30"), 100, 60.0, 1),
            ("unplanned", "İzmir", day("2025-05-01"), "Foça", at("2025-05-01T10:00"), at("2025-05-03T10:00"), 50, 30.0, 2),
            ("unplanned", "İzmir", day("2025-05-02"), "BUCA", at("2025-05-02T23:00"), None, None, None, 3),
        ],
        RAW,
    )


def test_outages_clip_to_their_day(spark):
    got = {(r["district"], str(r["date"])): r for r in records(X.outage_daily(outages(spark)))}
    foca = got[("FOÇA", "2025-05-01")]
    assert foca["outage_planned_minutes"] == 90 and foca["outage_unplanned_minutes"] == 840
    assert foca["outage_planned_kwh_lost"] == 90 and foca["outage_unplanned_sub_minutes"] == 42_000
    buca = got[("BUCA", "2025-05-02")]
    assert buca["outage_unplanned_minutes"] == 60 and buca["outage_planned_n"] == 0 and buca["outage_unplanned_subscribers"] == 0


def test_outages_join_both_depths_and_fill_zero(spark):
    panel = series(
        spark,
        [("a", day("2025-05-01"), "İZMİR > METROPOL > FOÇA"), ("b", day("2025-05-01"), "izmir>Foça"), ("a", day("2025-05-09"), "İZMİR > METROPOL > FOÇA")],
        "entity_id string, date date, location string",
    )
    got = {(r["entity_id"], str(r["date"])): r["outage_planned_minutes"] for r in records(X.outage_attach(panel, X.outage_daily(outages(spark))))}
    assert got == {("a", "2025-05-01"): 90, ("b", "2025-05-01"): 90, ("a", "2025-05-09"): 0}


def test_session_zone_does_not_matter(spark):
    rows = outages(spark).persist()
    want = records(X.outage_daily(rows), "district")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert records(X.outage_daily(rows), "district") == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hourly_features(spark):
    hours = [(d, h, 100.0 + (50 if h in (8, 20) else 0)) for d in days("2025-01-01", 9) for h in range(24)]
    got = records(X.hourly_daily_features(series(spark, hours, "date date, hour int, value double")), "date")
    assert got[0]["peak_hour"] == 8 and got[0]["dev_7"] is None and got[1]["dev_7"] == pytest.approx(0)
    assert got[0]["evening_ratio"] == pytest.approx(550 / 2500) and got[0]["night_ratio"] == pytest.approx(600 / 2500)


def ramp(spark):
    rows = []
    for i, d in enumerate(days("2025-01-01", 400)):
        s = i / 399
        rows.append((d, "X", -5 + 45 * s, 10 + 90 * s, 15 * s, 30 * s, 100 * s, 30 * s, 50 * s))
    names = "temperature_2m_mean relative_humidity_2m_mean wind_speed_10m_mean wind_gusts_10m_max cloud_cover_mean shortwave_radiation_sum precipitation_sum"
    return series(spark, rows, "date date, district string, " + ", ".join(f"{n} double" for n in names.split()))


def test_weather_physics_and_calendar_invariants(spark):
    out = C.spline_features(C.calendar_extra(WX.weather_physics(ramp(spark)))).toPandas()
    assert not out.isna().any().any() and (out["dew_point"] <= out["temperature_2m_mean"] + 1e-6).all()
    for p in ("doy", "dom", "dow"):
        assert abs(out[[f"{p}_sp_{i}" for i in range(3)]].sum(axis=1) - 1).max() < 1e-9
    seasons = out.set_index(out["date"].astype(str))["season"]
    assert [seasons[d] for d in ("2025-01-15", "2025-04-15", "2025-07-15", "2025-10-15")] == [0, 1, 2, 3]


def test_days_since_event(spark):
    rows = series(spark, [("X", d, r) for d, r in zip(days("2025-01-01", 6), [0, 0, 2, 0, 0, 1])], "district string, date date, rain int")
    got = [r["gap"] for r in records(WD.days_since_event(rows, F.col("rain") > 0, "gap"), "date")]
    assert got == [1, 2, 0, 1, 2, 0]
