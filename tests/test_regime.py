import numpy as np
from helpers import days, pandas, records, series
from pyspark.sql import functions as F

from panelyard.operators import regime as R
from panelyard.operators import scale as S

SCHEMA = "entity_id string, date date, value double, capacity double"


def panel(spark, factor: float, entity="a", n=120, seed=0):
    rng = np.random.default_rng(seed)
    values = rng.normal(50, 2, n)
    values[60:] *= factor
    return series(spark, [(entity, d, float(v), 100.0) for d, v in zip(days("2025-01-01", n), values)], SCHEMA)


def test_unit_change_is_found_and_unwound(spark):
    rows = panel(spark, 100.0)
    segments, state = R.detect_regimes(rows)
    found = records(segments, "seg")
    assert len(found) >= 2 and "scale" in [s["break_after"] for s in found]
    out = pandas(R.normalize_history(rows, segments), "date")
    early, late = np.median(out["value"][:55]), np.median(out["value"][65:])
    assert abs(early / late - 1) < 0.15
    assert np.allclose(out["value_raw"], pandas(rows, "date")["value"])
    assert records(state)[0]["regime_n_breaks"] >= 1


def test_step_is_labelled_and_left_alone(spark):
    rows = panel(spark, 1.8)
    segments, _ = R.detect_regimes(rows)
    assert "step" in [s["break_after"] for s in records(segments)]
    out = pandas(R.normalize_history(rows, segments), "date")
    assert np.allclose(out["value"], out["value_raw"])


def test_sleep_and_wake(spark):
    # Equal contrasts go to the earliest row, so a break sits up to half a probe early; the pause is long enough.
    d = days("2025-01-01", 240)
    values = [100.0] * 60 + [0.0] * 120 + [100.0] * 60
    rows = series(spark, [("a", x, v, 100.0) for x, v in zip(d, values)], SCHEMA)
    kinds = [s["break_after"] for s in records(R.regime_segments(rows), "seg")]
    assert kinds == ["sleep", "wake", "none"]


def test_rows_and_order_do_not_matter(spark):
    rows = panel(spark, 100.0, "a").union(panel(spark, 1.8, "b", 90, 1)).union(panel(spark, 1.0, "c", 90, 2))
    base = pandas(R.normalize_history(rows, R.regime_segments(rows)), "entity_id", "date")
    mixed = rows.orderBy(F.rand(7)).repartition(7)
    again = pandas(R.normalize_history(mixed, R.regime_segments(mixed)), "entity_id", "date")
    assert len(base) == rows.count() and base.equals(again) and not base.isna().any().any()


def recurse(y, lo, hi, depth, p, found):
    """Reference by recursion on one series."""
    if depth >= p.max_breaks or hi - lo < 2 * p.min_seg:
        return
    best, at = 0.0, None
    for i in range(lo + p.probe, hi - p.probe + 1):
        gap = round(abs(np.median(y[i : i + p.probe]) - np.median(y[i - p.probe : i])), 9)
        if gap > best:
            best, at = gap, i
    if at is None or best < p.tau:
        return
    found.append(at)
    recurse(y, lo, at, depth + 1, p, found)
    recurse(y, at, hi, depth + 1, p, found)


def test_rounds_equal_recursion(spark):
    rng = np.random.default_rng(9)
    p = R.RegimeParams()
    all_rows, want = [], {}
    for e in range(6):
        steps = np.repeat(rng.choice([1, 2, 5, 20], 8), 45)
        values = np.round(rng.gamma(20, 3, 360) * steps, 2)
        all_rows += [(f"e{e}", d, float(v), 100.0) for d, v in zip(days("2024-01-01", 360), values)]
        found: list[int] = []
        recurse(np.log1p(values), 0, 360, 0, p, found)
        want[f"e{e}"] = sorted(found)
    out = R.segment_breaks(series(spark, all_rows, SCHEMA))
    starts = {e: [] for e in want}
    for r in out.select("entity_id", "seg_lo").distinct().collect():
        if r["seg_lo"]:
            starts[r["entity_id"]].append(r["seg_lo"])
    assert {e: sorted(v) for e, v in starts.items()} == want and any(want.values())


def test_state_defaults_for_unknown_entities(spark):
    rows = panel(spark, 100.0)
    _, state = R.detect_regimes(rows)
    got = records(R.attach_state(series(spark, [("a",), ("new",)], "entity_id string"), state), "entity_id")
    assert got[0]["regime_last_break"] in (1, 2) and got[1]["regime_last_break"] == 0 and got[1]["regime_last_ratio"] == 1.0


def test_tasks_grow_with_the_fleet(spark, monkeypatch):
    rows = spark.range(600).selectExpr("concat('e', id % 30) AS entity_id", "date_add(DATE'2025-01-01', CAST(id DIV 30 AS INT)) AS date", "1.0D AS value", "9.0D AS capacity")
    small = R.segment_breaks(rows)
    monkeypatch.setattr(S, "TASK_ROWS", 50)
    many = R.segment_breaks(rows)
    assert S.spread(rows, "entity_id").rdd.getNumPartitions() == 12 and S.tasks_for(spark, 200) is None
    assert "entity_id" in many.columns and many.rdd.getNumPartitions() == 12 > small.rdd.getNumPartitions()
    assert records(many, "entity_id", "date") == records(small, "entity_id", "date")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_reading_meets_its_segment_without_a_window(spark):
    rows = panel(spark, 100.0, "a").union(panel(spark, 1.8, "b", 90, 1))
    segments, _ = R.detect_regimes(rows)
    out = R.normalize_history(rows, segments)
    assert "Window" not in executed(out)
    found = {(s["entity_id"], s["start"]): s["to_current"] for s in records(segments)}
    for r in records(out):
        began = max(start for entity, start in found if entity == r["entity_id"] and start <= r["date"])
        assert np.isclose(r["value"], r["value_raw"] * found[r["entity_id"], began])


def test_each_median_is_taken_once(spark):
    plan = R.window_median_contrast(panel(spark, 100.0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 1
