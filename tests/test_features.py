import numpy as np
import pytest
from helpers import days, pandas, series
from pyspark.sql import functions as F

from panelyard.functions.capacity import capacity_bucket_fixed, hurdle_dampen
from panelyard.operators import features as FT
from panelyard.operators import groups as G
from panelyard.operators import history as H
from panelyard.operators import profiles as PR

SCHEMA = "entity_id string, date date, value double, capacity double, province string, region string, district string"
WEATHER = "district string, date date, temperature_2m_mean double, cdd22 double, cdd_log double, hdd18 double"
CUT = "2025-07-01"


def panel(spark, extra=()):
    rng = np.random.default_rng(0)
    rows = []
    for e in range(6):
        start = 0 if e < 5 else 190
        for d in days("2025-01-01", 240)[start:]:
            rows.append((f"e{e}", d, float(np.round(rng.gamma(3, 30), 2)), [100.0, 400.0][e % 2], "P", "R", "AB"[e % 2]))
    return series(spark, rows + list(extra), SCHEMA).withColumns({"log_value": F.log1p("value"), "is_pos": (F.col("value") > 0).cast("int")})


def enriched(spark, rows):
    wx = [(p, d, 15 + 12 * np.sin(i / 40), max(0.0, 12 * np.sin(i / 40) - 7), 0.0, 1.0) for p in "AB" for i, d in enumerate(days("2025-01-01", 260))]
    return FT.enrich(rows, series(spark, [tuple(map(lambda x: float(x) if isinstance(x, np.floating) else x, r)) for r in wx], WEATHER))


def test_features_never_look_past_the_cut(spark):
    rows = panel(spark)
    block = pandas(FT.snapshot_block(enriched(spark, rows), CUT, CUT, "2025-08-01"), "entity_id", "date")
    future = enriched(spark, rows).withColumn(
        "value", F.when(F.col("date") >= F.lit(CUT).cast("date"), F.col("value") * 50).otherwise(F.col("value"))
    ).withColumn("log_value", F.log1p("value"))
    again = pandas(FT.snapshot_block(future, CUT, CUT, "2025-08-01"), "entity_id", "date")
    features = [c for c in FT.feature_list(FT.snapshot_block(enriched(spark, rows), CUT, CUT, "2025-08-01"))]
    assert block[features].equals(again[features]) and len(features) > 60
    assert set(block[block["seen"] == 0]["entity_id"]) == {"e5"}
    cold = block[block["entity_id"] == "e5"]
    assert cold["ent_mean"].notna().all() and np.allclose(cold["ent_mean"], cold["cell_mean"])


def test_block_matches_direct_history(spark):
    rows = panel(spark)
    block = pandas(FT.snapshot_block(enriched(spark, rows), CUT, CUT, "2025-07-05"), "entity_id", "date")
    hist = pandas(rows.where(F.col("date") < F.lit(CUT).cast("date")))
    for entity, group in hist.groupby("entity_id"):
        got = block[block["entity_id"] == entity].iloc[0]
        assert got["ent_mean"] == pytest.approx(group["log_value"].mean())
        assert got["ent_p90"] == pytest.approx(group["log_value"].quantile(0.9))
        last = group["date"].max()
        recent = group[[(last - d).days < 28 for d in group["date"]]]
        assert got["ent_r28_std"] == pytest.approx(recent["log_value"].std())


def test_capacity_buckets_are_right_closed(spark):
    rows = series(spark, [(0.0,), (1.0,), (100.0,), (100.5,), (1600.0,), (1e9,), (2e9,)], "c double")
    got = [r[0] for r in rows.select(capacity_bucket_fixed(F.col("c"))).collect()]
    assert got == [None, 0, 0, 1, 5, 6, None]


def test_hurdle_touches_seen_rows_only(spark):
    rows = series(spark, [(3.0, 0.25, True), (3.0, 0.25, False), (3.0, 0.95, True)], "p double, a double, s boolean")
    got = [r[0] for r in rows.select(hurdle_dampen(F.col("p"), F.col("a"), F.col("s"))).collect()]
    assert got[0] == pytest.approx(np.log1p(np.expm1(3.0) * 0.5)) and got[1:] == [pytest.approx(3.0)] * 2


def test_archetype_rule_order(spark):
    rows = []
    for d in days("2025-01-01", 365):
        summer, sunday = d.month in (6, 7, 8), d.weekday() == 6
        rows += [
            ("tourism", d, (300.0 if summer else 100.0) * (1.3 if sunday else 1.0)),
            ("five_day", d, 20.0 if sunday else 100.0),
            ("flat", d, 100.0),
            ("irrigation", d, 900.0 if summer else 100.0),
        ]
    got = {r["entity_id"]: r["archetype_code"] for r in PR.archetype_rules(series(spark, rows, "entity_id string, date date, value double")).collect()}
    assert got == {"tourism": 3, "five_day": 4, "flat": 5, "irrigation": 2}


def test_prefix_falls_back_to_the_fleet(spark):
    rows = series(spark, [("abc1", 0.0), ("abc1", 0.0), ("abc2", 5.0), ("xyz1", 7.0)], "entity_id string, value double").withColumn("log_value", F.log1p("value"))
    got = {r["entity_id"]: r for r in G.attach_prefix(series(spark, [("abc9",), ("new",)], "entity_id string"), rows).collect()}
    assert got["abc9"]["pfx3_dead"] == pytest.approx((1 + 5 / 3) / 7) and got["new"]["pfx3_dead"] == pytest.approx(1 / 3)
    assert got["new"]["pfx3_n"] == 0.0


def test_months_and_weekdays_come_as_one_row_per_entity(spark):
    profiles = spark.createDataFrame([("a", 3, None, 1.0), ("a", None, 0, 2.0), ("a", None, 6, 3.0), ("b", 12, None, 4.0)], "entity_id string, month int, dow int, level double")
    got = {r["entity_id"]: (r["_months"], r["_weekdays"]) for r in H.profile_arrays(profiles).collect()}
    assert got["a"] == ([None, None, 1.0] + [None] * 9, [2.0] + [None] * 5 + [3.0])
    assert got["b"] == ([None] * 11 + [4.0], [None] * 7)
