import uuid

import numpy as np
import pandas as pd
import pytest
from helpers import pandas, series
from pyspark.sql import functions as F

from panelyard.operators import spc as S
from panelyard.operators.scale import in_blocks
from panelyard.session import shared_dir
from panelyard.streaming import control as SC

KEYS = ["k"]


def example(seed=0):
    """500 points of trend and noise with a raised stretch, a spike and a lowered tail."""
    rng = np.random.default_rng(seed)
    x = np.linspace(100, 110, 500) + rng.normal(0, 5, 500)
    x[100:111] += 30
    x[200] += 60
    x[300:330] -= 20
    return x


def frame(spark, named: dict):
    rows = [(k, i, None if v is None or np.isnan(v) else float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return series(spark, rows, "k string, t long, v double")


def with_base(rows, limit=100):
    return rows.join(S.spc_fit(rows.where(F.col("t") < limit), KEYS, "v"), KEYS)


def nelson_brute(z):
    n = len(z)
    hit = np.abs(z) > 3
    out = hit.copy()
    for rows, agree, s in ((9, 9, 0), (3, 2, 2), (5, 4, 1)):
        for i in range(n - rows + 1):
            w = z[i : i + rows]
            if (w > s).sum() >= agree or (w < -s).sum() >= agree:
                out[i : i + rows] = True
    for i in range(n - 5):
        dz = np.diff(z[i : i + 6])
        if (dz > 0).all() or (dz < 0).all():
            out[i : i + 6] = True
    return out


def test_planted_anomalies_are_flagged(spark):
    x = example()
    got = pandas(S.spc_detect(with_base(frame(spark, {"a": x})), KEYS, "t", "v"), "t")
    assert got["is_anomaly"][200] and got["shewhart_anomaly"][200] and got["ewma_anomaly"][105:111].all()
    assert got["n_methods_flagged"].max() <= 4


def test_charts_equal_direct_computation(spark):
    x = example(3)
    got = pandas(S.spc_detect(with_base(frame(spark, {"a": x})), KEYS, "t", "v"), "t")
    m, s = x[:100].mean(), x[:100].std(ddof=1)
    z = (x - m) / s
    reach = 3 * np.abs(np.diff(x)).mean() / 1.128
    assert (got["shewhart_anomaly"] == (np.abs(x - m) > reach)).all()
    e = np.empty(500)
    e[0] = x[0]
    for i in range(1, 500):
        e[i] = 0.2 * x[i] + 0.8 * e[i - 1]
    assert np.allclose(got["ewma"], e)
    assert (got["nelson_anomaly"] == nelson_brute(z)).all()
    up = down = 0.0
    for i in range(500):
        p, n = max(0, up + z[i] - 0.5 * s), min(0, down + z[i] + 0.5 * s)
        assert got["cusum"][i] == pytest.approx(p - n)
        up, down = (0.0, 0.0) if p > 4.77 * s or n < -4.77 * s else (p, n)


def test_missing_values_flat_and_single_series(spark):
    x = example(1)[:80].copy()
    x[10] = np.nan
    rows = frame(spark, {"a": x, "flat": np.full(60, 5.0), "one": [3.0]})
    base = S.spc_fit(rows, KEYS, "v")
    got = pandas(S.spc_detect(rows.join(base, KEYS), KEYS, "t", "v"), "k", "t")
    assert not got[got.k == "flat"]["is_anomaly"].any() and not got[got.k == "one"]["is_anomaly"].any()
    a = got[got.k == "a"].reset_index(drop=True)
    assert a["ewma"][10] == a["ewma"][9] and a["cusum"][10] == a["cusum"][9] or a["cusum_anomaly"][9]
    leading = frame(spark, {"a": [np.nan, 1.0, 2.0]})
    lead = pandas(S.ewma(leading.withColumns({"baseline_mean": F.lit(1.0), "baseline_std": F.lit(1.0)}), KEYS, "t", "v"), "t")
    assert lead["ewma"].isna().all() and not lead["ewma_anomaly"].any()


def test_series_without_baseline_are_kept_unflagged(spark):
    rows = frame(spark, {"a": example()[:90], "short": [1.0, 90.0], "flat": np.full(70, 2.0)})
    base = S.spc_baseline_split(rows, KEYS, "t", "v", "v")
    out = S.spc_detect_multi(rows, base, KEYS, "t", "v")
    assert out.count() == rows.count()
    assert {r["k"] for r in base.collect()} == {"a"}
    assert out.where("k <> 'a' AND (is_anomaly OR n_methods_flagged > 0)").count() == 0


def test_partitioning_does_not_matter(spark):
    rows = with_base(frame(spark, {c: example(i)[:150] for i, c in enumerate("abcdef")}))
    one = pandas(S.spc_detect(rows, KEYS, "t", "v"), "k", "t")
    two = pandas(S.spc_detect(rows.orderBy(F.rand(3)).repartition(11), KEYS, "t", "v"), "k", "t")
    pd.testing.assert_frame_equal(one, two)


def test_stream_equals_batch_over_several_triggers(spark):
    rows = frame(spark, {c: example(i)[:120] for i, c in enumerate("abc")})
    base = S.spc_fit(rows.where("t < 60"), KEYS, "v")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for part in range(3):
        rows.where((F.col("t") >= part * 40) & (F.col("t") < part * 40 + 40)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    config = S.SPCConfig(cusum_units="standard")
    got = SC.run_to_table(SC.stream_score_stateful(stream, base, "k", "t", "v", config), folder, "out")
    batch = S.sequential_charts(rows.join(base, KEYS), KEYS, "t", "v", config)
    names = ["k", "t", "ewma", "ewma_anomaly", "cusum", "cusum_anomaly"]
    pd.testing.assert_frame_equal(pandas(got.select(*names), "k", "t"), pandas(batch.select(*names), "k", "t"))


def test_detrending_short_series_is_flat(spark):
    got = pandas(S.centered_median_detrend(frame(spark, {"a": [1.0, 5.0, 9.0]}), KEYS, "t", "v"), "t")
    assert got["resid"].sum() == pytest.approx(0) and got["resid"].abs().max() > 0


def test_stratified_split_is_exact_and_repeatable(spark):
    rows = spark.range(10_000).select(F.col("id"), (F.col("id") % 20 == 0).alias("is_anomaly"))
    split = S.stratified_split(rows, ["id"]).persist()
    report = {r["is_test"]: r for r in S.split_report(split).collect()}
    assert report[True]["rows"] == 2000 and report[True]["anomaly_rate_pct"] == pytest.approx(5.0)
    again = S.stratified_split(rows.repartition(13), ["id"])
    assert split.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0


def test_segments_and_settings():
    with pytest.raises(ValueError):
        S.SPCConfig(ewma_lambda=0)
    assert S.PRESETS["aggressive"].shewhart_multiplier < S.PRESETS["conservative"].shewhart_multiplier


def test_ewma_over_blocks_equals_the_sequential_scan(spark):
    rng = np.random.default_rng(5)
    long, holes = rng.normal(50, 9, 4000), rng.normal(5, 1, 700)
    holes[rng.random(700) < 0.3] = np.nan
    holes[0] = 4.0
    unknown = np.r_[np.nan, rng.normal(0, 1, 60)]
    named = {"long": long, "holes": holes, "unknown": unknown, "one": [3.0], "none": [None, None], None: rng.normal(1, 1, 90)}
    rows = frame(spark, named)
    base = series(spark, [("long", 50.0, 9.0), ("holes", 5.0, 1.0), ("unknown", 0.0, 1.0), ("one", 3.0, 0.0)], "k string, baseline_mean double, baseline_std double")
    rows = rows.join(base, KEYS, "left").repartition(6)
    config = S.SPCConfig(ewma_lambda=0.2)
    names = ["k", "t", "ewma", "ewma_upper", "ewma_lower", "ewma_anomaly"]
    want = pandas(S.ewma(rows, KEYS, "t", "v", config).select(*names), "k", "t")
    got = S.ewma(rows, KEYS, "t", "v", config, block_rows=300)
    assert got.columns == S.ewma(rows, KEYS, "t", "v", config).columns
    pd.testing.assert_frame_equal(pandas(got.select(*names), "k", "t"), want, rtol=1e-9, atol=1e-9)
    blocks = in_blocks(rows, "t", 300)
    assert blocks.where("k = 'long'").select("_block").distinct().count() > 8 and in_blocks(rows, "t", 1 << 20) is None
    spans = sorted((r["a"], r["b"]) for r in blocks.groupBy("_block").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect())
    assert all(b < a for (_, b), (a, _) in zip(spans, spans[1:]))


def test_ordered_stream_equals_the_batch_charts(spark):
    """Three triggers, rows shuffled inside the delay: every row behind the watermark comes out in event order."""
    rng = np.random.default_rng(8)
    start = pd.Timestamp("2025-01-01", tz="UTC")
    parts = []
    for k in ("a", "b", "c"):
        x = rng.normal(10, 2, 120)
        x[rng.random(120) < 0.1] = np.nan
        parts.append(pd.DataFrame({"k": k, "n": range(120), "ts": [start + pd.Timedelta(hours=i // 2) for i in range(120)], "v": x}))
    whole = pd.concat(parts)
    rows = spark.createDataFrame(whole).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    base = series(spark, [("a", 10.0, 2.0), ("b", 9.0, 1.0)], "k string, baseline_mean double, baseline_std double")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    # a row arrives in its own file or, being late by up to five hours, in the next one
    arrives = F.least(F.floor((F.col("n") + F.pmod(F.xxhash64("k", "n"), F.lit(10))) / 40), F.lit(2))
    for part in range(3):
        rows.where(arrives == part).orderBy(F.xxhash64("n")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = SC.with_state_store(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    config = S.SPCConfig(cusum_units="standard")
    got = SC.run_to_table(SC.stream_score_ordered(stream, base, "k", "ts", "n", "v", "6 hours", config), folder, "out")
    batch = S.sequential_charts(rows.join(base, KEYS, "left"), KEYS, "n", "v", config)
    names = ["k", "n", "ewma", "ewma_anomaly", "cusum", "cusum_anomaly"]
    passed = batch.where(F.col("ts") <= F.lit(start + pd.Timedelta(hours=59 - 6)))
    pd.testing.assert_frame_equal(pandas(got.select(*names), "k", "n"), pandas(passed.select(*names), "k", "n"))
