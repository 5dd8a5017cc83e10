import numpy as np
import pytest
from helpers import day, days, records, series
from pyspark.sql import functions as F

from panelyard.operators import clean

SCHEMA = "entity_id string, date date, capacity double, value double"


def test_extreme_readings_use_earlier_values_only(spark):
    d = days("2025-01-01", 3)
    rows = series(spark, [("t1", d[0], 10.0, 10.0), ("t1", d[1], 10.0, 1000.0), ("t1", d[2], 10.0, 30.0), ("t2", d[0], 10.0, 1000.0)], SCHEMA)
    got = {(r["entity_id"], r["date"]): r["value"] for r in records(clean.declip(rows))}
    assert got[("t1", d[1])] == 10.0 and got[("t1", d[2])] == 30.0 and got[("t2", d[0])] == 0.0
    assert rows.agg(F.max("value")).first()[0] == 1000.0


def test_appended_rows_do_not_change_the_past(spark):
    rng = np.random.default_rng(3)
    d = days("2025-01-01", 60)
    values = rng.gamma(2, 40, 60)
    values[[20, 33]] *= 100
    rows = series(spark, [("a", x, 50.0, float(v)) for x, v in zip(d, values)], SCHEMA)
    whole = {r["date"]: r["value"] for r in records(clean.declip(rows))}
    part = {r["date"]: r["value"] for r in records(clean.declip(rows.where(F.col("date") < day("2025-02-15"))))}
    assert part == {k: whole[k] for k in part} and whole[d[20]] < values[20]


def test_running_median_equals_numpy():
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(10, 3, 200), 1)
    values[rng.random(200) < 0.1] = np.nan
    step = clean.prior_median_step()
    position = np.arange(1, 201)
    # Two batches of one key, then a second key: state continues and then restarts.
    got = np.concatenate([step(position[:70], values[:70])[0], step(position[70:], values[70:])[0]])
    assert step(np.array([1, 2]), np.array([4.0, 6.0]))[0].tolist() == [0.0, 4.0]
    for i in range(200):
        seen = values[:i][~np.isnan(values[:i])]
        assert np.isclose(got[i], np.median(seen) if len(seen) else 0.0)


def test_prior_median_equals_brute_force_over_batches():
    rng = np.random.default_rng(3)
    step = clean.prior_median_step()
    for size in (1, 2, 5, 400):
        values = np.round(rng.normal(0, 2, size), 1)
        values[rng.random(size) < 0.2] = np.nan
        cuts = sorted({0, size, *rng.integers(0, size, 3).tolist()})
        got = np.concatenate([step(np.arange(a, b) + 1, values[a:b])[0] for a, b in zip(cuts, cuts[1:])])
        for i in range(size):
            known = values[:i][~np.isnan(values[:i])]
            assert got[i] == pytest.approx(np.median(known) if len(known) else 0.0)


def test_prior_median_of_a_long_series_is_not_quadratic():
    import time

    values = np.random.default_rng(1).random(1_000_000)
    step = clean.prior_median_step()
    started = time.perf_counter()
    out = step(np.arange(len(values)) + 1, values)[0]
    assert time.perf_counter() - started < 20 and out[-1] == pytest.approx(np.median(values[:-1]))
