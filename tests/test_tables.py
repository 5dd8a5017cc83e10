import re

from pyspark.sql import functions as F

from panelyard.operators import groups as G
from panelyard.operators.contract import longest_run
from panelyard.operators.groups import entity_life
from panelyard.operators.profiles import regime_shift_features
from panelyard.plans import tables as T


def test_household_tasks_grow_with_the_marks(spark, tmp_path, monkeypatch):
    tables = {
        "customer": spark.range(1, 41).selectExpr("id AS c_custkey", "0 AS c_nationkey"),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey"),
        "region": spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name"),
        "orders": spark.range(120).selectExpr("1 + id % 40 AS o_custkey", "date_add(DATE'2000-01-01', CAST(id % 7 AS INT)) AS o_orderdate", "100.0D AS o_totalprice"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    few = T.household(spark, str(tmp_path))
    monkeypatch.setattr(T, "MARKS", 5)
    many = T.household(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 40 > few.rdd.getNumPartitions()
    for rows in (few, many):
        assert rows.agg(F.count("*"), F.count_distinct("entity_id"), F.sum("value")).first()[:] == (280, 40, 120.0)


def test_windows_by_entity_do_not_move_the_expanded_days(spark, tmp_path):
    tables = {
        "customer": spark.range(1, 5).selectExpr("id AS c_custkey", "0 AS c_nationkey"),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey"),
        "region": spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name"),
        "orders": spark.range(8).selectExpr("1 + id % 4 AS o_custkey", "date_add(DATE'2000-01-01', CAST(id AS INT)) AS o_orderdate", "100.0D AS o_totalprice"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = T.household(spark, str(tmp_path))

    flagged = rows.withColumn("zero", F.col("value") == 0)
    for df in (longest_run(flagged, ["entity_id"], "date", "zero", "longest"), regime_shift_features(rows), entity_life(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(entity_id.*REPARTITION_BY_NUM", plan)
        assert not re.search(r"hashpartitioning\(.*entity_id.*ENSURE_REQUIREMENTS", plan)


def test_prefix_attach_passes_over_the_readings_once(spark, monkeypatch):
    life, seen = G.entity_life, []
    monkeypatch.setattr(G, "entity_life", lambda hist: seen.append(hist) or life(hist))
    hist = spark.createDataFrame([("aa1", 0.0, 0.0), ("aa1", 1.0, 0.5), ("ab2", 0.0, 0.0)], "entity_id string, value double, log_value double")
    out = {r["entity_id"]: r for r in G.attach_prefix(spark.createDataFrame([("aa9",), ("zz9",)], "entity_id string"), hist, (1, 2)).collect()}
    assert len(seen) == 1
    assert out["aa9"]["pfx1_dead"] == (0.5 * 2 + 0.5 * 5) / 7 and out["aa9"]["pfx2_dead"] == 0.5 * 5 / 6
    assert out["zz9"]["pfx2_dead"] == 0.5 and out["zz9"]["pfx2_mean"] == 0.125 and out["zz9"]["pfx2_n"] == 0


def test_weather_takes_a_stored_panel(spark, tmp_path, monkeypatch):
    tables = {
        "lineitem": spark.range(40).selectExpr(
            "1 + id % 3 AS l_suppkey", "date_add(DATE'2000-01-01', CAST(id % 7 AS INT)) AS l_shipdate", "id % 4 AS l_linenumber", "1 + id % 9 AS l_quantity",
            "100.0D * id AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax", "'N' AS l_returnflag",
        ),
        "supplier": spark.range(1, 4).selectExpr("id AS s_suppkey", "id % 2 AS s_nationkey", "5000.0D AS s_acctbal"),
        "nation": spark.range(2).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id AS n_regionkey"),
        "region": spark.range(2).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rows = T.panel(spark, str(tmp_path))
    expected = sorted(map(str, T.weather(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(T, "panel", None)
    assert expected and sorted(map(str, T.weather(spark, str(tmp_path), rows).collect())) == expected
