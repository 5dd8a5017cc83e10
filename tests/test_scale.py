import numpy as np
import pandas as pd
import pytest
from helpers import day, records, series
from pyspark.sql import functions as F

from panelyard.operators import scale as S


@pytest.mark.parametrize("n, decimals", [(1, 3), (2, 3), (7, 3), (1000, 6), (5000, 1)])
def test_exact_quantiles_equal_numpy_for_hot_and_tied_groups(spark, n, decimals):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"k": ["hot"] * n + ["cold"] * 5, "v": np.round(rng.normal(0, 10, n + 5), decimals)})
    probs = {"lo": 0.0, "p5": 0.05, "mid": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r["k"]: r for r in records(S.exact_quantiles(spark.createDataFrame(frame), ["k"], "v", probs, accuracy=200))}
    for key, group in frame.groupby("k"):
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(group["v"], p), abs=1e-9)


def test_exact_quantiles_without_keys_skip_nulls(spark):
    rows = series(spark, [(1.0,), (None,), (4.0,), (2.0,)], "v double")
    assert S.exact_quantiles(rows, [], "v", {"m": 0.5}).first()["m"] == 2.0


def test_nearest_within_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    left = pd.DataFrame({"id": range(400), "k": rng.choice(["a", "b"], 400, p=[0.9, 0.1]), "x": rng.integers(0, 3000, 400)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 150, p=[0.9, 0.1]), "x": rng.integers(0, 3000, 150)})
    right["name"] = [f"n{i}" for i in range(150)]
    got = S.nearest_within(spark.createDataFrame(left), spark.createDataFrame(right), "k", "x", 20, {"name": "name"})
    best = {r["id"]: r["name"] for r in records(got)}
    assert len(best) == 400
    for row in left.itertuples():
        near = right[(right.k == row.k) & ((right.x - row.x).abs() <= 20)]
        want = None
        if len(near):
            want = min(zip((near.x - row.x).abs(), near.x, near.name))[2]
        assert best[row.id] == want


def test_nearest_before(spark):
    left = series(spark, [("a", day("2025-01-05")), ("a", day("2025-01-01")), ("b", day("2025-01-05"))], "k string, t date")
    right = series(spark, [("a", day("2025-01-02"), 1), ("a", day("2025-01-05"), 2)], "k string, t date, v int")
    got = {(r["k"], str(r["t"])): r["v"] for r in records(S.nearest_before(left, right, "k", "t", ["v"]))}
    assert got == {("a", "2025-01-05"): 2, ("a", "2025-01-01"): None, ("b", "2025-01-05"): None}


def test_keep_one_is_whole_and_deterministic(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), (F.col("id") * 2).alias("v")).repartition(9)
    assert {r["k"]: r["v"] for r in records(S.keep_one(rows, ["k"], F.col("t")))} == {k: 2 * k for k in range(7)}
    latest = records(S.keep_one(rows, ["k"], F.col("t"), largest=True))
    assert all(r["t"] > 4990 for r in latest) and len(latest) == 7


def test_measured_small_tables_are_broadcast_by_size(spark):
    facts = spark.range(1000).withColumn("k", F.col("id") % 5)
    dim = facts.groupBy("k").agg(F.count("*").alias("n"))
    plan = S.attach(facts, dim, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        plan = S.attach(facts, dim, "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("kind", ["plain", "ties", "outliers"])
def test_one_group_of_all_rows_is_narrowed_to_few_values(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, 30_000)
    if kind == "ties":
        v = np.round(v, 1)
    if kind == "outliers":
        v[:5], v[5:10] = 1.7e308, -1.7e308
    frame = pd.DataFrame({"k": ["hot"] * 29_000 + [f"g{i % 7}" for i in range(1000)], "v": v})
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.77, "e": 1.0}
    rounds, largest = [], []
    plain = S.narrow_brackets

    def counted(spread, keys, ranges=256):
        rounds.append(1)
        out = plain(spread, keys, ranges)
        largest.append(out.select(F.explode("_wanted").alias("w"), "_inside").where("w.lo < w.hi").agg(F.max("_inside")).first()[0] or 0)
        return out

    monkeypatch.setattr(S, "narrow_brackets", counted)
    df = spark.createDataFrame(frame)
    for keys in (["k"], []):
        rounds.clear()
        got = {r["k"] if keys else None: r for r in records(S.exact_quantiles(df, keys, "v", probs, accuracy=50, most=40))}
        assert rounds and largest[-1] <= 40
        for key, part in frame.groupby("k") if keys else [(None, frame)]:
            want = [float(np.quantile(part["v"], p)) for p in probs.values()]
            assert [got[key][n] for n in probs] == pytest.approx(want, rel=1e-12)


def test_asof_of_a_hot_key_is_spread_over_blocks(spark):
    rng = np.random.default_rng(9)
    left = pd.DataFrame({"k": ["hot"] * 2000 + list(rng.choice(["a", "b"], 300)), "t": np.r_[rng.integers(0, 5000, 2000), rng.integers(0, 5000, 300)], "n": np.arange(2300)})
    right = pd.DataFrame({"k": ["hot"] * 300 + ["a"] * 3, "t": np.r_[np.sort(rng.choice(5000, 300, False)), [10, 2500, 4999]]})
    right["v"], right["w"] = right["t"] * 1.0, np.where(right["t"] % 3 == 0, None, right["t"])
    ldf = spark.createDataFrame(left)
    rdf = spark.createDataFrame([(r.k, int(r.t), float(r.v), None if r.w is None else int(r.w)) for r in right.itertuples()], "k string, t long, v double, w long")
    rdf = rdf.withColumnRenamed("t", "at").withColumn("t", F.col("at")).select("k", "t", "v", "w")
    for rows in (S.BLOCK_ROWS, 150):
        got = {r["n"]: (r["v"], r["w"]) for r in S.nearest_before(ldf, rdf, "k", "t", ["v", "w"], block_rows=rows).collect()}
        for k, t, n in left.itertuples(index=False):
            past = right[(right.k == k) & (right.t <= t)]
            want = (None, None) if past.empty else (past.iloc[past.t.argmax()].v, past.iloc[past.t.argmax()].w)
            assert got[n] == want
    blocks = S.in_blocks(ldf, "t", 150)
    assert blocks.where("k = 'hot'").groupBy("_block").count().agg(F.max("count")).first()[0] < 600
