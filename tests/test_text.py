import pytest
from helpers import day, records, series
from pyspark.sql import functions as F

from panelyard.functions import text as X


def one(spark, expression, value, kind="string"):
    return series(spark, [(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, number",
    [("1.222.817,98", 1222817.98), ("12,5", 12.5), ("7", 7.0), (" 3,25 ", 3.25), ("", None), ("abc", None), (None, None)],
)
def test_local_numerals(spark, text, number):
    assert one(spark, X.tr_number, text) == number


@pytest.mark.parametrize("text, date", [("05.03.2025", "2025-03-05"), ("05.03.2025 13:00", "2025-03-05"), ("2025-03-05", None), ("32.01.2025", None)])
def test_local_dates(spark, text, date):
    assert one(spark, X.tr_date, text) == (day(date) if date else None)


@pytest.mark.parametrize("text, period", [("3.2025", "2025-03"), ("1.11.2024", "2024-11"), ("2024", "2024")])
def test_periods(spark, text, period):
    assert one(spark, X.period_norm, text) == period


@pytest.mark.parametrize("text, place", [("İzmir", "İZMİR"), ("IZMIR", "İZMİR"), ("manisa", "MANİSA"), (" Foça - (merkez) ", "FOÇA MERKEZ")])
def test_place_names_meet(spark, text, place):
    assert one(spark, X.norm_place, text) == place


def test_location_depths(spark):
    rows = series(spark, [("a > b > c",), ("a>b",), (" a ",), ("a > b > c > d",)], "location string")
    got = {r["location"]: (r["province"], r["region"], r["district"]) for r in records(X.parse_location(rows))}
    assert got == {"a > b > c": ("a", "b", "c"), "a>b": ("a", "a", "b"), " a ": ("a", "a", "a"), "a > b > c > d": ("a", "b", "c")}
    served = X.parse_location(rows, missing_region=F.lit(""))
    assert {r["location"]: r["region"] for r in records(served)}[" a "] == ""


def test_labels_ids_and_accents(spark):
    assert one(spark, X.day_label, day("2026-04-15"), "date") == "15-04 (wed)"
    assert one(spark, X.numeric_id, "TR-0012x7") == 12
    assert one(spark, X.numeric_id, "none") is None
    assert one(spark, X.deaccent, "Çeşme ığdır ÖÜİ") == "Cesme igdir OUI"
