import numpy as np
import pytest
from helpers import records, series

from panelyard.operators import priors as P


def minimax(v, w):
    n = len(v)
    return [max(min(np.average(v[i : j + 1], weights=w[i : j + 1]) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_pooling_equals_minimax():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        v, w = np.round(rng.normal(0, 1, n), 1), rng.integers(1, 9, n).astype(float)
        assert np.allclose(P.pool_adjacent(v, w), minimax(v, w))


def test_cold_prior_is_monotone_capped_and_falls_back(spark):
    rows = []
    for cap, level in ((50.0, 2.0), (100.0, 6.0), (250.0, 3.0)):
        rows += [("R", cap, level)] * 20
    rows += [("S", 50.0, 1.0)] * 10
    hist = series(spark, rows, "region string, capacity double, log_value double")
    cells = {(r["region"], r["capacity"]): r for r in records(P.cold_prior(hist))}
    r = [cells[("R", c)] for c in (50.0, 100.0, 250.0)]
    assert all(abs(x["prior"] - x["shrunk"]) <= 1.0 + 1e-12 for x in r)
    plain = {(x["region"], x["capacity"]): x["prior"] for x in records(P.cold_prior(hist, monotone=False))}
    assert plain[("R", 50.0)] == pytest.approx((2.0 * 20 + (11 / 3) * 5) / 25)
    free = [x["prior"] for x in records(P.cold_prior_winsor(hist), "region", "capacity") if x["region"] == "R"]
    assert free == sorted(free)
    asked = series(spark, [("R", 50.0, False), ("R", 999.0, False), ("Z", 1.0, False)], "region string, capacity double, seen boolean")
    got = {(x["region"], x["capacity"]): x["prior"] for x in records(P.attach_prior(asked, P.cold_prior(hist), P.fleet_mean(hist)))}
    assert got[("R", 999.0)] == pytest.approx(11 / 3) and got[("Z", 1.0)] == pytest.approx((11 / 3 * 60 + 10) / 70)
