import numpy as np
import pytest
from helpers import days, records, series
from pyspark.sql import functions as F

from panelyard.functions.calendar import TURKEY
from panelyard.operators import holiday as H

SCHEMA = "entity_id string, date date, district string, capacity double, log_value double, value double"
PLANTED = {"A": -0.60, "B": 0.30}


def history(spark, n=60):
    rng = np.random.default_rng(4)
    feast = set(TURKEY.feast)
    rows = []
    for e in range(n):
        district = "A" if e % 2 == 0 else "B"
        level = 5 + rng.normal(0, 0.5)
        for d in days("2025-01-01", 240):
            y = level + rng.normal(0, 0.02) + (PLANTED[district] if d.isoformat() in feast else 0.0)
            rows.append((f"{district}{e}", d, district, 100.0 if e % 4 < 2 else 400.0, float(y), float(np.expm1(y))))
    return series(spark, rows, SCHEMA)


def test_blocks_are_runs_of_days():
    assert H.feast_blocks(["2025-03-30", "2025-04-01", "2025-03-31", "2025-06-06"]) == [("2025-03-30", "2025-04-01"), ("2025-06-06", "2025-06-06")]


def test_planted_responses_return_and_reach_new_entities(spark):
    hist = history(spark)
    ahead = [(e, d, p, 100.0, None, None) for e, p in (("A0", "A"), ("newA", "A"), ("newB", "B"), ("newC", "C")) for d in days("2026-05-25", 7)]
    out = records(H.feast_response(series(spark, ahead, SCHEMA), hist))
    own = {r["entity_id"]: r for r in records(H.feast_deviation(hist))}
    assert all(r["deviation"] == pytest.approx(PLANTED[e[0]], abs=0.05) and r["feast_days"] == 7 for e, r in own.items())
    fleet = np.mean(list(PLANTED.values()))
    # Fifteen entities per cohort against five pseudo-counts of the fleet, then seven own days against four.
    cohort = {p: (15 * PLANTED[p] + 5 * fleet) / 20 for p in PLANTED}
    want = {"newA": cohort["A"], "newB": cohort["B"], "newC": fleet, "A0": (7 * PLANTED["A"] + 4 * cohort["A"]) / 11}
    for r in out:
        on_feast = r["date"].isoformat() in set(TURKEY.feast)
        assert r["feast_dev"] == pytest.approx(want[r["entity_id"]] if on_feast else 0.0, abs=0.05 if on_feast else 0.0)


def test_no_feast_in_history_means_zero(spark):
    hist = history(spark, 4).where(F.col("date") < F.lit("2025-02-20").cast("date"))
    out = H.feast_response(hist, hist)
    assert out.where("feast_dev <> 0").count() == 0
