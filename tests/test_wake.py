import math

import numpy as np
from helpers import day, days, records, series
from pyspark.sql import functions as F

from panelyard.operators import wake as W

SCHEMA = "entity_id string, date date, value double, province string, district string"
CUT = "2026-04-01"


def fleet(spark, silent: bool):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(12 if silent else 8):
        for d in days("2025-02-25", 400):
            if silent:
                value = 0.0 if e < 6 else float(rng.normal(300, 10))
            else:
                value = float(rng.normal(500, 20)) if d.month in (6, 7) else 0.0
            rows.append((f"e{e}", d, value, "P", "D"))
    return series(spark, rows, SCHEMA)


def asked(spark, entities):
    return series(spark, [(e, d, None, "P", "D") for e in entities for d in days("2026-06-01", 10)], SCHEMA)


def test_silent_cohort_is_left_alone(spark):
    hist = fleet(spark, True)
    out = records(W.seasonal_wake_apply(asked(spark, [f"e{i}" for i in range(12)]), hist, CUT))
    assert len(out) == 120 and all(r["wake"] is None for r in out)


def test_seasonal_cohort_wakes(spark):
    hist = fleet(spark, False)
    out = records(W.seasonal_wake_apply(asked(spark, ["e0", "e1"]), hist, CUT))
    assert all(0 < r["wake"] < math.log1p(500) + 1 for r in out)


def test_fallback_to_currently_dormant(spark):
    hist = fleet(spark, False).where("date >= DATE '2025-09-01'")
    fit = records(W.seasonal_wake_fit(hist, CUT))
    assert {r["scope"] for r in fit} == {"entity", "district", "province", "fleet"} and all(r["p"] == 0 for r in fit)


def test_dormancy_windows_differ_by_one_day(spark):
    rows = series(spark, [("a", day("2026-03-04"), 5.0), ("a", day("2026-03-20"), 0.0), ("b", day("2026-04-01"), 5.0), ("b", day("2026-03-20"), 0.0)], "entity_id string, date date, value double")
    before = {r["entity_id"] for r in records(W.dormant_before(rows, W.day(CUT)))}
    until = {r["entity_id"] for r in records(W.dormant_until(rows, W.day(CUT)))}
    assert before == {"b"} and until == {"a"}
    flags = {r["entity_id"]: r["prior_active"] for r in records(W.dormancy_flags(rows, CUT))}
    assert flags == {"a": True}


def test_rows_dealt_by_entity_are_not_moved(spark):
    hist = spark.sql("SELECT concat('e', e) AS entity_id, 'd' AS district, 'p' AS province, date_add(DATE '2024-01-01', x) AS date, 0.0D AS value FROM (SELECT explode(sequence(0, 2)) AS e), (SELECT explode(sequence(0, 400)) AS x)")
    rows = hist.where("date < DATE '2024-03-01'").repartition(3, "entity_id")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = W.seasonal_wake_apply(rows, hist, "2025-02-01", W.WakeParams(min_wake_p=0.0))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 180 and plan.count("hashpartitioning") == plan.count("hashpartitioning(entity_id") + plan.count("hashpartitioning(_c0") and "month(" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
        assert {r["wake"] for r in out.collect()} == {0.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_the_fit_passes_the_history_once(spark, tmp_path):
    for silent in (True, False):
        odd = [(None, day("2025-03-20"), 0.0, "P", "D"), ("n", day("2025-03-20"), None, "P", "D"), ("n", day("2025-07-01"), 9.0, "P", None), ("e0", day("2025-08-01"), None, "P", None)]
        path = f"{tmp_path}/{silent}"
        fleet(spark, silent).unionByName(series(spark, odd, SCHEMA)).write.parquet(path)
        hist = spark.read.parquet(path)
        fit = W.seasonal_wake_fit(hist, CUT)
        assert not [f for f in fit.inputFiles() if path in f]  # only cells are read again
        then = W.dormant_before(hist, F.lit("2025-04-01").cast("date"))
        rows = hist.where("date >= DATE '2025-04-01' AND date < DATE '2026-04-01'").join(then, "entity_id", "left_semi").toPandas()
        assert rows.entity_id.notna().all() and len(rows)
        fleetwide = next(r for r in records(fit) if r["scope"] == "fleet")
        assert (fleetwide["n"], fleetwide["p"]) == (len(rows), (rows.value > 0).sum() / len(rows))
        months = rows.groupby(["entity_id", rows.date.map(lambda d: d.month)]).value.agg(["size", lambda v: (v > 0).mean()])
        assert {(r["key"], r["month"]): (r["n"], r["p"]) for r in records(fit) if r["scope"] == "entity"} == {k: tuple(v) for k, v in zip(months.index, months.to_numpy().tolist())}
