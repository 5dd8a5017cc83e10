import numpy as np
import pandas as pd
import pytest
from helpers import records

from panelyard.operators import evaluate as E
from panelyard.operators import explain as X
from panelyard.operators import predictions as P


def scored(spark, n=400):
    rng = np.random.default_rng(0)
    district = np.where(np.arange(n) % 4 == 0, "B", "A")
    y = rng.normal(5, 1, n)
    pred = y + rng.normal(0, 1, n) * np.where(district == "B", 0.5, 0.01)
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "y": y, "pred": pred, "district": district, "feat": rng.random(n)}))


def test_bad_segment_dominates(spark):
    report = records(X.segment_report(X.add_error_columns(scored(spark)), ["district"]))
    assert report[0]["district"] == "B" and report[0]["lift"] > 2 and report[0]["share_of_error"] > 0.9


def test_bias_curve_finds_a_ramp_and_not_noise(spark):
    rng = np.random.default_rng(1)
    feat = rng.uniform(0, 10, 600)
    ramp = spark.createDataFrame(pd.DataFrame({"y": np.zeros(600), "pred": 0.1 * feat, "feat": feat}))
    noise = spark.createDataFrame(pd.DataFrame({"y": np.zeros(600), "pred": rng.normal(0, 1, 600), "feat": feat}))
    assert all(r["monotonic_bias"] for r in records(X.bias_curve(X.add_error_columns(ramp), "feat")))
    assert not any(r["monotonic_bias"] for r in records(X.bias_curve(X.add_error_columns(noise), "feat")))


def test_quantile_bins_equal_pandas(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"id": range(500), "feat": np.round(rng.gamma(1, 2, 500), 0)})
    want = pd.qcut(frame["feat"], 10, duplicates="drop", labels=False)
    got = {r["id"]: r["bin"] for r in records(X.quantile_bins(spark.createDataFrame(frame), "feat"))}
    assert [got[i] for i in range(500)] == want.tolist()


def test_worst_first_and_regression_isolated(spark):
    rows = scored(spark)
    worst = records(X.worst_cases(X.add_error_columns(rows), ["id"], k=10))
    assert [w["abs_err"] for w in worst] == sorted((w["abs_err"] for w in worst), reverse=True)
    shifted = rows.selectExpr("id", "y", "district", "pred + CASE WHEN district = 'B' THEN 1 ELSE 0 END AS pred")
    table = {r["district"]: r for r in records(X.compare_predictions(rows, shifted, ["id"], ["district"]))}
    assert table["B"]["verdict"] == "regressed" and table["A"]["verdict"] == "same" and table["A"]["overall_delta"] > 0
    sections = {r["section"] for r in records(X.error_report(rows, ["district"], ["feat"], ["id"]))}
    assert sections == {"overall", "segment:district", "bias:feat", "worst"}


def folds(spark, shift=0.0):
    rng = np.random.default_rng(6)
    n = 600
    frame = pd.DataFrame({"y": rng.normal(5, 1, n), "seen": np.arange(n) % 5 != 0, "horizon": np.arange(n) % 122 + 1, "fold": [str(i % 3) for i in range(n)], "entity_id": [f"e{i % 40}" for i in range(n)]})
    frame["pred"] = frame["y"] + rng.normal(0, 0.5, n) * (1 + shift)
    return spark.createDataFrame(frame), frame


def test_segments_and_gate(spark):
    base, frame = folds(spark, 0.2)
    better = base.selectExpr("y", "seen", "horizon", "fold", "entity_id", "y + (pred - y) * 0.8 AS pred")
    got = {r["segment"]: r["value"] for r in records(E.oof_segments(base))}
    e = frame["pred"] - frame["y"]
    assert got["all"] == pytest.approx(np.sqrt((e**2).mean())) and got["unseen_share"] == pytest.approx(0.2)
    assert got["h1_30"] == pytest.approx(np.sqrt((e[frame["horizon"] <= 30] ** 2).mean()))
    good = records(E.acceptance_gate(E.oof_segments(base), E.oof_segments(better)))[0]
    assert good["passes"] and good["reasons"] == ""
    bad = records(E.acceptance_gate(E.oof_segments(better), E.oof_segments(base)))[0]
    assert not bad["passes"] and "regress:seen" in bad["reasons"] and "horizon:h1_30" in bad["reasons"]
    lost = records(E.acceptance_gate(E.oof_segments(base), E.oof_segments(better), informative=["9"]))[0]
    assert lost["reasons"] == "no_informative_fold"


def test_weighted_metric_falls_back(spark):
    base, frame = folds(spark)
    plain = records(E.metrics(base.where("seen"), ["pred"]))[0]
    assert plain["weighted_rmsle"] == pytest.approx(plain["rmsle"]) and plain["unseen_rmsle"] is None


def test_bootstrap_covers_the_point_estimate(spark):
    base, frame = folds(spark)
    rows = base.selectExpr("*", "pred AS pred_a", "y + (pred - y) * 0.7 AS pred_b")
    got = records(E.cluster_bootstrap(rows, resamples=300))[0]
    e = frame["pred"] - frame["y"]
    s, u = frame["seen"], ~frame["seen"]
    point = -0.3 * np.sqrt((1 - E.UNSEEN_SHARE) * (e[s] ** 2).mean() + E.UNSEEN_SHARE * (e[u] ** 2).mean())
    assert got["ci_lower"] < point < got["ci_upper"] < 0 and got["excludes_zero"] and got["resamples"] == 300
    assert got == records(E.cluster_bootstrap(rows.repartition(5), resamples=300))[0] or abs(got["mean"] - point) < 0.02


def test_blend_weights_equal_a_grid(spark):
    rng = np.random.default_rng(12)
    y = rng.normal(0, 1, 300)
    a, b = y + rng.normal(0, 1, 300), y + rng.normal(0.2, 0.5, 300)
    got = records(E.blend_weights(spark.createDataFrame(pd.DataFrame({"y": y, "pred_a": a, "pred_b": b}))))[0]
    grid = np.linspace(0, 1, 2001)
    loss = [np.sqrt(np.mean((w * a + (1 - w) * b - y) ** 2)) for w in grid]
    assert got["w_first"] == pytest.approx(grid[int(np.argmin(loss))], abs=1e-3)
    assert got["blend_rmsle"] == pytest.approx(min(loss), abs=1e-6)


def test_alignment_is_by_key(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", 2.5), (1, "b", 1.5)], "id int, version string, log_pred double")
    wide = P.assert_aligned(P.aligned_wide(rows, ["id"], ["a", "b"]), ["a", "b"])
    assert records(P.prediction_diff_stats(wide, "a", "b"))[0]["mean_move"] == 0.5
    with pytest.raises(P.AlignmentError):
        P.assert_aligned(P.aligned_wide(rows.where("NOT (id = 1 AND version = 'b')"), ["id"], ["a", "b"]), ["a", "b"])
