"""Registered queries against their SQL on the smallest tables. Set PANELYARD_ALL=1 to check every one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = (
    "parse_location", "find_duplicates", "declip", "group_levels", "cold_prior_winsor", "feast_response", "snapshot_block", "weather_rolling",
    "outage_daily", "seasonal_wake_apply", "spc_detect_multi", "regime_state", "nearest_part_band", "comparison_table", "acceptance_gate",
    "bias_curve", "stream_score_stateful",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="shared tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return None
        return x if isinstance(x, str) else round(float(x), 9)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=str)


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SAMPLE) <= set(entry.oracle_sql())


def test_every_check_is_valid_sql(duck):
    for name, sql in entry.oracle_sql().items():
        duck.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("PANELYARD_ALL") else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(
    ("name", "columns"),
    [("entity_history", ("ent_zero", "ent_r28_zero", "ent_zero_trend")), ("district_dynamics", ("dist_r28_zero",)), ("target_flags", ("target_true_zero",)), ("attach_origin", ("seen_at_origin",))],
)
def test_columns_about_zero_days_and_new_meters_vary(spark, name, columns):
    got = entry.queries()[name](spark, DATA).select(*columns).toPandas()
    assert all(got[c].nunique() > 1 for c in columns)


def test_nothing_is_left_out_of_the_panels(spark):
    from panelyard.plans import tables as T

    line, orders = T.table(spark, DATA, "lineitem"), T.table(spark, DATA, "orders")
    readings = T.train(spark, DATA).count() + T.test_rows(spark, DATA).count()
    assert readings == line.selectExpr("l_suppkey", "to_date(l_shipdate)").distinct().count()
    bought = T.household(spark, DATA).where("value > 0").count()
    assert bought == orders.where("o_totalprice > 0").selectExpr("o_custkey", "to_date(o_orderdate)").distinct().count()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
