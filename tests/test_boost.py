import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.operators import boost as B

FULL = B.TreeParams(trees=4, depth=3, step=0.4, subsample=1.0, bins=16, columns=1.0, least=5)


def table(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 4)).round(2)
    y = 2 + 2 * (x[:, 0] > 0.4) + x[:, 1] * (x[:, 2] > 0.6) + rng.gumbel(0, 0.3, n)
    frame = pd.DataFrame(x, columns=list("abcd"))
    frame["d"] = np.where(frame["d"] > 0.7, np.nan, frame["d"])
    frame["kind"] = np.where(x[:, 0] > 0.4, "high", "low")
    return frame.assign(y=y, block=np.arange(n) % 4, id=np.arange(n))


def spark_table(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("d", F.when(~F.isnan("d"), F.col("d"))).repartition(5, "id")


def plain_fit(bins, y, p, q):
    """One arm, grown node by node with all rows in memory; returns the training predictions."""
    score = np.full(len(y), np.quantile(y, q))
    for _ in range(p.trees):
        residual, add = y - score, np.zeros(len(y))

        def split(rows, depth):
            best = (1e-9, 0, 0)
            pull = np.where(residual[rows] > 0, -q, 1 - q)
            for f in range(len(bins)):
                for b in range(p.bins):
                    left = bins[f, rows] <= b
                    nl, nr = left.sum(), (~left).sum()
                    if min(nl, nr) < p.least:
                        continue
                    gain = round(pull[left].sum() ** 2 / nl + pull[~left].sum() ** 2 / nr - pull.sum() ** 2 / len(rows), 9)
                    if gain > best[0]:
                        best = (gain, f, b)
            if depth == p.depth or len(rows) < 2 * p.least or best[0] <= 1e-9:
                add[rows] = p.step * np.quantile(residual[rows], q)
                return
            left = bins[best[1], rows] <= best[2]
            split(rows[left], depth + 1)
            split(rows[~left], depth + 1)

        split(np.arange(len(y)), 0)
        score = score + add
    return score + np.quantile(y - score, q)


def numpy_bins(frame, encoding):
    out = np.zeros((len(encoding.names), len(frame)), np.uint8)
    for k, name in enumerate(encoding.names):
        v = frame[name].to_numpy()
        known = ~np.isnan(v)
        out[k, known] = 1 + np.searchsorted(encoding.thresholds[name], v[known], "left")
    return out


@pytest.mark.parametrize("q", [0.55, 0.1])
def test_equals_a_plain_boosting(spark, q):
    frame = table()
    model = B.fit_many(spark_table(spark, frame), [B.Arm("m", tuple("abcd"), FULL, quantile=q)], "y")["m"]
    got = model.predict(spark_table(spark, frame)).select("id", "pred").toPandas().sort_values("id")["pred"].to_numpy()
    want = plain_fit(numpy_bins(frame, model.encoding), frame["y"].to_numpy(), FULL, q)
    assert got == pytest.approx(np.maximum(want, 0), abs=1e-9)
    # the last leaf puts the wanted share of the training rows at or below the prediction
    assert (frame["y"] <= got + 1e-9).sum() == int(q * (len(frame) - 1)) + 1
    assert list(model.importances())[0] == "a" and sum(len(t.feature) for t in model.trees) == 2 * 2 + 4 * 16


def test_arms_fitted_together_equal_arms_fitted_alone(spark):
    rows = spark_table(spark, table())
    arms = [
        B.Arm("one", ("a", "b", "c"), B.TreeParams(trees=12, depth=3, bins=16, least=5), seed=1),
        B.Arm("two", ("a", "b", "c"), B.TreeParams(trees=3, depth=5, step=0.3, bins=16, least=5), seed=2, quantile=0.8),
        B.Arm("three", ("c", "a"), B.TreeParams(trees=11, depth=2, bins=16, subsample=0.5, least=5), seed=1),
    ]
    joint = B.fit_many(rows, arms, "y")
    for arm in arms:
        alone = B.fit_many(rows, [arm], "y")[arm.name]
        for t, u in zip(joint[arm.name].trees, alone.trees, strict=True):
            names = {k: n for k, n in enumerate(joint[arm.name].encoding.names)}
            mine = {k: n for k, n in enumerate(alone.encoding.names)}
            assert [names.get(f) for f in t.feature] == [mine.get(f) for f in u.feature]
            assert (t.split == u.split).all() and t.value == pytest.approx(u.value, abs=1e-12)
    assert not set(joint["three"].importances()) - {"a", "c"}


def test_an_arm_learns_from_its_rows_only(spark):
    frame = table()
    other = frame.assign(y=np.where(frame["block"] == 3, 50.0, frame["y"]))
    arms = [B.Arm("early", tuple("abc"), FULL, rows=F.col("block") < 3), B.Arm("later", tuple("abc"), FULL, rows=F.col("block") >= 1)]
    first, second = (B.fit_many(spark_table(spark, f), arms, "y") for f in (frame, other))
    for t, u in zip(first["early"].trees, second["early"].trees, strict=True):
        assert (t.feature == u.feature).all() and (t.value == u.value).all()
    assert any((t.value != u.value).any() for t, u in zip(first["later"].trees, second["later"].trees, strict=True))


def test_leaf_quantiles_of_many_rows_are_exact(spark, monkeypatch):
    monkeypatch.setattr(B, "SENT", 64)  # a few residuals per round: brackets have to narrow
    rng = np.random.default_rng(4)
    y = np.r_[rng.normal(0, 1, 3000), np.full(2000, 0.25), rng.normal(1e6, 1, 50), [-1e300, 0.0, -0.0]]
    frame = pd.DataFrame({"id": np.arange(len(y)), "a": 1.0, "y": y})
    for q in (0.0, 0.3, 0.55, 0.999, 1.0):
        model = B.fit_many(spark_table(spark, frame.assign(d=1.0)), [B.Arm("m", ("a",), B.TreeParams(trees=0), quantile=q)], "y")["m"]
        assert model.trees[0].value[1] == np.quantile(y, q)


def test_categories_missing_columns_and_empty_arms(spark):
    frame = table(300)
    rows = spark_table(spark, frame).withColumn("never", F.lit(None).cast("double")).withColumn("inf", F.lit(float("inf")))
    models = B.fit_many(rows, [B.Arm("m", ("never", "inf", "d"), FULL), B.Arm("none", ("d",), FULL, rows=F.col("id") < 0)], "y", categories=("kind",))
    assert models["m"].features == () or set(models["m"].features) <= {"d", "kind__t"}
    alone = B.fit_many(rows, [B.Arm("m", ("never", "inf", "d"), FULL)], "y", categories=("kind",))["m"]
    assert list(alone.importances())[0] == "kind__t" and "never" not in alone.importances()
    new = rows.limit(5).withColumn("kind", F.lit("unseen"))
    out = alone.predict(new)
    assert out.columns == [*new.columns, "pred"] and out.where("pred IS NULL").count() == 0
    assert B.predict(rows, {"p": models["none"]}).agg(F.max("p")).first()[0] == 0.0
    with pytest.raises(ValueError):
        B.fit_many(rows, [B.Arm("m", ("a",)), B.Arm("m", ("a",))], "y")
    assert B.fit_many(rows.where("y IS NULL"), [B.Arm("m", ("a",), FULL)], "y")["m"].predict(rows).agg(F.max("pred")).first()[0] == 0.0


def test_a_moderate_table_is_spread_over_the_cores(spark):
    rows = spark.range(40_000).selectExpr("id", "rand(1) AS a", "rand(2) AS y")
    arms = [B.Arm("m", ("a",))]
    matrix, tasks, _ = B.binned(rows, arms, B.encode(rows, ["a"], (), "y", 16), "y")
    cores = spark.sparkContext.defaultParallelism
    assert tasks == min(4, cores)
    seen = [c.rows for r in matrix.collect() for c in [B.Chunk([pa.py_buffer(v) for v in r], 1)]]
    assert sum(seen) == 40_000 and matrix.rdd.getNumPartitions() <= tasks


def test_a_bracket_of_one_value_sends_no_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "SENT", 64)
    asked = []
    real = B.starts
    monkeypatch.setattr(B, "starts", lambda low, high, *rest: asked.append(low == high) or real(low, high, *rest))
    rows = spark.range(30_000).selectExpr("id", "1.0D AS a", "IF(id % 10 = 0, id / 30000, 0.25D) AS y")
    model = B.fit_many(rows, [B.Arm("m", ("a",), B.TreeParams(trees=0))], "y")["m"]
    assert model.trees[0].value[1] == 0.25 and asked and not any(asked)


def test_bits_of_doubles_go_back(spark):
    for x in (0.0, -1.5, 2.25, 1e300, -1e-300):
        assert B.of_bits(int(B.ordered_bits(np.array([x]))[0])) == x


def test_sketches_are_spread_over_the_cores(spark):
    rows = spark.range(8 * B.LEAST, numPartitions=1)
    assert B.dealt(rows, 8 * B.LEAST).rdd.getNumPartitions() == 8
    assert B.dealt(rows, 10).rdd.getNumPartitions() == 1


def test_thresholds_are_exact_on_few_rows_and_close_on_many(spark, monkeypatch):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"a": rng.normal(0, 1, 4000).round(2), "b": np.where(rng.uniform(size=4000) < 0.3, np.nan, rng.integers(0, 9, 4000))})
    frame.loc[5, "a"] = np.inf
    rows, shares = spark.createDataFrame(frame).repartition(3), [k / 15 for k in range(1, 15)]
    found = B.quantiles(rows.withColumn("none", F.lit(None).cast("int")), ["a", "b", "none"], shares)
    assert sorted(found) == [0, 1]
    for k, c in enumerate("ab"):
        x = np.sort(frame[c][np.isfinite(frame[c])].to_numpy())
        assert found[k].tolist() == [x[int(np.ceil(p * len(x))) - 1] for p in shares]
        assert found[k].tolist() == rows.agg(F.percentile_approx(F.when(F.abs(c) < float("inf"), F.col(c)), F.array(*[F.lit(p) for p in shares]), 10_000)).first()[0]
    monkeypatch.setattr(B, "POINTS", 500)
    monkeypatch.setattr(B, "HELD", 2000)
    many = spark.range(60_000, numPartitions=4).selectExpr("(id * 7919) % 60000 / 60000 AS x")
    assert B.quantiles(many, ["x"], shares)[0] == pytest.approx(shares, abs=0.02)


def test_few_histograms_are_summed_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(B, "LEAST", 100)
    rows, arms = spark_table(spark, table()), [B.Arm("m", tuple("abcd"), FULL), B.Arm("n", ("a", "c"), FULL, seed=3)]
    shuffled, real = [], B.best_splits

    def counted(matrix, plan):
        assert plan.tasks > 1
        before = {f.__name__: f for f in (B.keep_best,)}
        monkeypatch.setattr(B, "keep_best", lambda *x: shuffled.append(0) or before["keep_best"](*x))
        try:
            return real(matrix, plan)
        finally:
            monkeypatch.setattr(B, "keep_best", before["keep_best"])

    monkeypatch.setattr(B, "best_splits", counted)
    here = B.fit_many(rows, arms, "y")
    assert shuffled  # the driver summed them
    monkeypatch.setattr(B, "best_splits", real)
    monkeypatch.setattr(B, "TOLD", 0)
    there = B.fit_many(rows, arms, "y")
    for name in here:
        for t, u in zip(here[name].trees, there[name].trees, strict=True):
            assert (t.feature == u.feature).all() and (t.split == u.split).all() and (t.value == u.value).all()


def test_leaves_that_fit_one_round_together_take_one_round(spark, monkeypatch):
    frame = table(2000)
    monkeypatch.setattr(B, "SENT", 2600)  # 2,000 residuals fit, but the largest leaf has more than an equal share
    asked, real = [], B.starts
    rows = spark_table(spark, frame)
    monkeypatch.setattr(B, "starts", lambda low, high, turn, *rest: asked.append(turn) or real(low, high, turn, *rest))
    B.fit_many(rows, [B.Arm("m", tuple("abc"), FULL)], "y")
    # the first and the last leaf, of unknown size, are counted once each; those of the trees are sent at once
    assert asked == [0, 0]


def test_only_the_smaller_child_of_a_node_is_counted(spark, monkeypatch):
    rows = spark_table(spark, table(1500))
    deep = B.TreeParams(trees=2, depth=4, step=0.4, subsample=0.7, bins=16, columns=0.8, least=5)
    arms = [B.Arm("m", tuple("abcd"), deep), B.Arm("n", ("a", "c"), FULL, seed=3), B.Arm("o", ("b",), deep, rows=F.col("block") < 2)]
    asked, real = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda matrix, plan: asked.append(plan.nodes) or real(matrix, plan))
    held = B.fit_many(rows, arms, "y")
    nodes = [n.tolist() for level in asked for n in level if len(n)]
    assert any(max(n) >= 8 for n in nodes)
    assert not [n for n in nodes if n != [1] and any(node ^ 1 in n for node in n)]
    # the same trees where the driver may hold no level and every node is counted
    asked.clear()
    monkeypatch.setattr(B, "KEPT", 0)
    counted = B.fit_many(rows, arms, "y")
    assert not asked
    for name in held:
        for t, u in zip(held[name].trees, counted[name].trees, strict=True):
            assert (t.feature == u.feature).all() and (t.split == u.split).all() and (t.value == u.value).all()


def test_tasks_fill_whole_rounds_of_the_cores(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 1000)
    monkeypatch.setattr(B, "LEAST", 10)
    rows, cores = spark.range(1), spark.sparkContext.defaultParallelism
    assert [B.tasks_of(rows, n) for n in (0, 25, 1000 * cores, 1000 * cores + 1)] == [1, 2, cores, 2 * cores]
