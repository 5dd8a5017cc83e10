import threading

import numpy as np
import pandas as pd
import pytest
from helpers import days, records
from pyspark.sql import functions as F

from panelyard.operators import boost as B
from panelyard.operators import features as FT
from panelyard.operators import history as H
from panelyard.operators import models as M
from panelyard.operators.boost import predict

TINY = M.TreeParams(trees=3, depth=3, step=0.3)


def rows(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    y = 3 + 2 * (x > 0.5) + rng.normal(0, 0.1, n)
    frame = pd.DataFrame(
        {"entity_id": [f"e{i % 20}" for i in range(n)], "date": [days("2025-01-01", 30)[i % 30] for i in range(n)], "x": x, "z": z, "log_value": y,
         "value": np.where(z > 0.3, np.expm1(y), 0.0), "seen": (np.arange(n) % 5 != 0).astype(int), "horizon": np.arange(n) % 90 + 1, "capacity": 100.0, "ent_zero": (z <= 0.3).astype(float)}
    )
    return spark.createDataFrame(frame)


def test_forecaster_learns_and_ranks(spark):
    train = rows(spark).withColumn("never", F.lit(None).cast("double"))
    model = M.fit_forecaster(train, ["x", "z", "never"], params=TINY)
    out = model.predict(rows(spark, seed=1).withColumn("never", F.lit(1.0))).select("x", "pred").toPandas()
    assert out[out.x > 0.5]["pred"].mean() - out[out.x <= 0.5]["pred"].mean() > 1.0
    assert list(model.importances())[0] == "x" and model.features == ("x", "z")
    above = train.count() * 0.55
    below = model.predict(train).where(F.col("log_value") <= F.col("pred") + 1e-9).count()
    assert below == pytest.approx(above, abs=25)


def test_activity_probabilities_are_clipped(spark):
    model = M.fit_activity(rows(spark), params=TINY)
    out = model.predict(rows(spark, seed=2)).select("p_active", "ent_zero").toPandas()
    assert out["p_active"].between(0.001, 0.999).all()
    assert out[out.ent_zero == 0]["p_active"].mean() > out[out.ent_zero == 1]["p_active"].mean() + 0.3


def test_ablation_and_reduction(spark):
    train, valid = rows(spark), rows(spark, seed=3)
    arms = {r["arm"]: r for r in records(M.ablation(train, valid, ["x", "z"], {"no_x": ["x"]}, TINY))}
    assert arms["no_x"]["delta"] > 0.3 and arms["all"]["delta"] == 0
    reduced = {r["dropped"]: r for r in records(M.rank_features(train, valid, ["x", "z"], (0, 1), TINY))}
    assert reduced[1]["kept"] == 1 and reduced[1]["rmsle"] < arms["no_x"]["rmsle"]


def test_walk_forward_uses_earlier_blocks_only(spark):
    blocks = rows(spark, 200, 0).withColumn("block", F.lit(0))
    for i in (1, 2):
        blocks = blocks.unionByName(rows(spark, 200, i).withColumn("block", F.lit(i)))
    out = M.walk_forward(blocks, ["x", "z"], 2, {"a": TINY, "b": M.TreeParams(trees=1, depth=2)})
    assert out.count() == 200 and {r["fold"] for r in out.select("fold").distinct().collect()} == {"2"}


def test_the_activity_classifier_runs_in_few_tasks_over_its_inputs_alone(spark, monkeypatch):
    held = []
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, df: held.append((df.columns, df.rdd.getNumPartitions())))
    train, cores = rows(spark), spark.sparkContext.defaultParallelism
    M.fit_activity(train.withColumn("wide", F.lit("x")).repartition(3 * cores))
    features = M.numeric_features(train, M.ACTIVITY_FEATURES)
    assert held == [([*features, "label", *[f"{c}__m" for c in features]], cores)]
    monkeypatch.setattr(M, "ROWS", 1)
    M.fit_activity(train.repartition(3 * cores))
    assert held[1][1] == 3 * cores


def test_predictions_move_only_the_kept_columns_and_the_inputs(spark):
    train = rows(spark, 300)
    model = M.fit_forecaster(train, ["x", "z"], params=TINY)
    both = predict(train, {"pred": model, "raw": model}, {"raw": None}, ["entity_id", "date"])
    assert both.columns == ["entity_id", "date", "pred", "raw"]
    whole = model.predict(train).select("entity_id", "date", "pred")
    assert sorted(map(tuple, both.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert both.where("pred <> greatest(raw, 0D)").count() == 0


def test_the_reduced_sets_take_the_thresholds_of_the_full_one(spark, monkeypatch):
    encoded, real = [], B.encode
    monkeypatch.setattr(B, "encode", lambda *x: encoded.append(x[1]) or real(*x))
    M.rank_features(rows(spark), rows(spark, seed=3), ["x", "z"], (0, 1), TINY).collect()
    assert len(encoded) == 1


def test_blocks_are_made_side_by_side(spark, monkeypatch):
    panel, together = rows(spark, 400), threading.Barrier(2, timeout=60)

    def block(panel, cut, start, end):
        together.wait()  # fails unless both are under way
        return H.target_window(panel, start, end).withColumn("cut", F.lit(cut))

    monkeypatch.setattr(FT, "snapshot_block", block)
    cuts = [("2025-01-01", "2025-01-01", "2025-01-11"), ("2025-01-11", "2025-01-11", "2025-02-01")]
    out = FT.blocks_by_cut(panel, cuts)
    found = {(r["block"], r["cut"]): r["n"] for r in out.groupBy("block", "cut").agg(F.count("*").alias("n")).collect()}
    assert found == {(i, cut): H.target_window(panel, start, end).count() for i, (cut, start, end) in enumerate(cuts)}
