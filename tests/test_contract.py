import pytest
from helpers import day, days, records, series
from pyspark.sql import functions as F

from panelyard.operators import contract as C

TRAIN = "entity_id string, capacity double, date date, value double, province string, region string, district string"
TEST = "entity_id string, capacity double, date date, province string, region string, district string"
PLACE = ("P", "R", "D")


def train(spark):
    t1 = [("t1", 100.0, d, 10.0 if i < 10 else 0.0, *PLACE) for i, d in enumerate(days("2025-01-01", 40))]
    t2 = [("t2", 100.0, d, 5.0, *PLACE) for d in days("2025-01-01", 5)]
    return series(spark, t1 + t2, TRAIN)


def test(spark):
    rows = [("t1", 100.0, d, *PLACE) for d in days("2025-02-15", 3)] + [("t3", 100.0, day("2025-02-15"), *PLACE)]
    return series(spark, rows, TEST)


test.__test__ = False


def panel(spark):
    return C.target_flags(C.canonical_panel(train(spark), test(spark)))


def test_panel_keeps_every_row_and_zero(spark):
    rows = records(panel(spark))
    assert sum(r["is_train"] for r in rows) == 45 and len(rows) == 49
    assert sum(r["target_true_zero"] for r in rows) == 30
    assert not any(r["target_missing"] or r["suspected_data_error"] for r in rows)


def test_duplicates_are_found_and_rejected(spark):
    doubled = train(spark).union(train(spark).where("entity_id = 't1' AND date = DATE '2025-01-01'"))
    assert C.find_duplicates(doubled).count() == 2
    with pytest.raises(C.ContractError, match="duplicate"):
        C.canonical_panel(doubled, test(spark))


def test_history_is_causal(spark):
    early = {r["entity_id"]: r for r in records(C.history_asof(panel(spark), "2025-01-05"))}
    assert early["t1"]["n_history_days_at_origin"] == 4 and not early["t1"]["long_zero_run"]
    late = {r["entity_id"]: r for r in records(C.history_asof(panel(spark), "2025-02-15"))}
    assert late["t1"]["n_history_days_at_origin"] == 40 and late["t1"]["long_zero_run"]
    assert late["t1"]["days_since_last_positive"] == (day("2025-02-15") - day("2025-01-10")).days
    assert late["t1"]["zero_share_history"] == 0.75 and "t3" not in late


def test_cold_start_at_origin(spark):
    rows = [r for r in records(C.attach_origin(panel(spark), "2025-02-15")) if r["is_test"]]
    cold = [r for r in rows if r["entity_id"] == "t3"]
    assert [r["seen_at_origin"] for r in cold] == [False] and cold[0]["n_history_days_at_origin"] == 0
    assert min(r["horizon"] for r in rows if r["entity_id"] == "t1") == 0
    report = records(C.contract_report(panel(spark), "2025-02-15"))[0]
    assert report["cold_start_share"] == 0.25 and report["test_rows"] == 4


def test_contract_verdict(spark):
    found = C.check_contract(panel(spark))
    assert found == {"n_rows": 49, "n_entities": 3, "suspected_data_error_rows": 0, "test_entities_with_gaps": 0, "test_entities": 2}
    negative = train(spark).withColumn("value", F.when(F.col("date") == day("2025-01-02"), -5.0).otherwise(F.col("value")))
    with pytest.raises(C.ContractError, match="negative kWh"):
        C.check_contract(C.target_flags(C.canonical_panel(negative, test(spark))))
    flat = train(spark).withColumn("capacity", F.lit(0.0))
    with pytest.raises(C.ContractError, match="capacity"):
        C.check_contract(C.target_flags(C.canonical_panel(flat, test(spark))))


def test_gaps(spark):
    rows = series(spark, [("a", day("2025-01-01")), ("a", day("2025-01-04")), ("b", day("2025-01-01"))], "entity_id string, date date")
    assert [r["date"] for r in records(C.calendar_gaps(rows), "date")] == days("2025-01-02", 2)


def test_copies_with_a_missing_key_are_reported(spark):
    rows = series(spark, [(None, day("2025-01-01"), 1), (None, day("2025-01-01"), 2), ("a", None, 3), ("a", None, 4), ("a", day("2025-01-01"), 5)], "entity_id string, date date, k int")
    assert sorted(r["k"] for r in C.find_duplicates(rows).collect()) == [1, 2, 3, 4]
