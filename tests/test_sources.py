import hashlib
import json
import os
import random
import shutil

import pytest
from helpers import day, records, series
from pyspark.sql import functions as F

from panelyard.operators import marts as M
from panelyard.sources import exports as X
from panelyard.sources import panel as P
from panelyard.sources import sinks as S
from panelyard.sources.store import EventStore


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_hourly_export_first_file_wins(spark, tmp_path):
    head = "﻿Tarih;Saat;Yük Tahmin Planı (MWh) \n"
    a = write(tmp_path / "a.csv", head + "01.01.2025;00:00;1.234,50\n01.01.2025;01:00;x\n")
    b = write(tmp_path / "b.csv", head + "01.01.2025;00:00;9,00\n02.01.2025;05:00;7,25\n")
    got = [(str(r["date"]), r["hour"], r["value"]) for r in records(X.read_hourly_export(spark, [a, b]), "date", "hour")]
    assert got == [("2025-01-01", 0, 1234.5), ("2025-01-01", 1, None), ("2025-01-02", 5, 7.25)]


def test_mapped_export_takes_known_columns(spark, tmp_path):
    a = write(tmp_path / "a.csv", "Tarih;Saat;Toplam(MWh);Gunes;Bilinmeyen\n01.01.2025;03:00;10,0;4,0;1\n")
    b = write(tmp_path / "b.csv", "Tarih;Saat;Toplam(MWh);Rüzgar\n01.01.2025;04:00;20,0;5,0\n")
    got = records(X.read_hourly_mapped(spark, [a, b], X.GENERATION_PLAN), "hour")
    assert got[0] == {"date": day("2025-01-01"), "hour": 3, "total": 10.0, "wind": None, "solar": 4.0}
    assert got[1]["wind"] == 5.0 and got[1]["solar"] is None


def test_province_months_last_file_wins(spark, tmp_path):
    a = write(tmp_path / "x (1).csv", "Dönem;Mesken (MWh);Genel Toplam (MWh)\n02.2024;1,0;2,0\n")
    b = write(tmp_path / "x (2).csv", "Dönem;Genel Toplam (MWh);Sanayi (MWh)\n02.2024;2.900,0;3,0\n")
    got = records(X.read_province_monthly(spark, {"P": [a, b]}))
    assert len(got) == 1 and got[0]["days"] == 29 and got[0]["daily_mean"] == pytest.approx(100) and got[0]["residential"] is None


def test_reports_and_fingerprint(spark, tmp_path):
    write(tmp_path / "one.json", json.dumps({"lb": 1.2, "cv_mean": 0.5}))
    write(tmp_path / "two.json", json.dumps({"other": 1}))
    write(tmp_path / "bad.json", "{oops")
    got = {r["file_name"]: (r["headline_metric"], r["headline_value"]) for r in records(X.read_json_reports(spark, str(tmp_path)))}
    assert got == {"one.json": ("cv_mean", "0.5"), "two.json": (None, None)}
    path = str(tmp_path / "one.json")
    assert X.source_fingerprint(spark, str(tmp_path / "gone")) == "missing"
    first = X.source_fingerprint(spark, path)
    size, stamp = os.stat(path).st_size, os.stat(path).st_mtime_ns // 1_000_000 * 1_000_000
    assert first == hashlib.sha1(f"{size}:{stamp}".encode()).hexdigest()[:12]


def test_panel_file_round_trip(spark, tmp_path):
    path = write(
        tmp_path / "train.csv",
        "tanim,guc,tarih,tuketim,lokasyon\nt1,100,2025-01-01,10.5,İZMİR > METROPOL > FOÇA\nt1,100,2025-01-02,99999,İZMİR > METROPOL > FOÇA\nt2,50,2025-01-01,,MANİSA > SOMA\n",
    )
    got = records(P.read_panel(spark, path), "entity_id", "date")
    assert got[0]["district"] == "FOÇA" and got[1]["value"] == pytest.approx(9.9999) and got[2]["value"] is None and got[2]["district"] == "SOMA"
    test = write(tmp_path / "test.csv", "id,tanim,guc,tarih,lokasyon\n1,t1,100,2025-02-01,İZMİR > FOÇA\n")
    assert "value" not in P.read_panel(spark, test).columns


def test_coordinates_accept_lists_only(spark, tmp_path):
    path = write(tmp_path / "c.json", json.dumps({"FOÇA": [38.6, 26.7]}, ensure_ascii=False, indent=1))
    rows = series(spark, [("FOÇA",), ("YOK",)], "district string")
    got = records(P.geo_attach(rows, P.read_coords(spark, path)), "district")
    assert (got[0]["lat"], got[0]["lon"], got[1]["lat"]) == (38.6, 26.7, None)


def test_forecast_is_checked_before_writing(spark, tmp_path):
    rows = series(spark, [(1, 2.0), (2, -3.0)], "id int, pred double")
    out = str(tmp_path / "out")
    S.write_forecast(rows, 2, out)
    got = {r["id"]: float(r["value"]) for r in spark.read.option("header", True).csv(out).collect()}
    assert got["2"] == 0.0 and got["1"] == pytest.approx(6.389056)
    with pytest.raises(S.ForecastError):
        S.write_forecast(rows, 3, out)
    with pytest.raises(S.ForecastError):
        S.write_forecast(rows.withColumn("pred", F.lit(None).cast("double")), 2, out)
    # a refused table leaves the one before, and nothing beside it; a good one takes its place
    assert spark.read.option("header", True).csv(out).count() == 2
    S.write_forecast(rows.where("id = '1'"), 1, out)
    assert [r["id"] for r in spark.read.option("header", True).csv(out).collect()] == ["1"]
    left = [n for n in os.listdir(os.path.dirname(out.rstrip("/"))) if n.startswith(os.path.basename(out.rstrip("/")))]
    assert left == [os.path.basename(out.rstrip("/"))]


def test_event_upsert_and_ledger(spark):
    old = series(spark, [("k", 1, 10, "old"), ("k", 2, 10, "old")], "kind string, outage_id int, version int, reason string")
    new = series(spark, [("k", 1, 10, "new"), ("k", 3, 1, "new")], "kind string, outage_id int, version int, reason string")
    got = {r["outage_id"]: r["reason"] for r in records(X.upsert_events(old, new, ["kind", "outage_id"], "version"))}
    assert got == {1: "new", 2: "old", 3: "new"}
    wanted = series(spark, [("k", "P", day("2025-01-01")), ("k", "P", day("2025-01-02"))], "kind string, province string, date date")
    done = series(spark, [("k", "P", day("2025-01-01"), 0)], "kind string, province string, date date, n int")
    assert [str(r["date"]) for r in records(X.fetch_ledger(wanted, done))] == ["2025-01-02"]


def entities(spark):
    return series(
        spark,
        [("a", 100.0, 5.0, "D", "Seen"), ("b", 50.0, None, "D", "Cold Start"), ("c", 70.0, 9.0, "D", "Seen"), ("d", 70.0, 5.0, "E", "Seen")],
        "entity_id string, capacity double, train_mean double, district string, status string",
    ).withColumns({"province": F.lit("P"), "region": F.lit("R"), "location": F.concat(F.lit("P > "), "district")})


def test_serving_queries(spark):
    rows = entities(spark)
    assert [r["entity_id"] for r in M.paged_list(rows, "train_mean", True).collect()] == ["c", "a", "d", "b"]
    assert [r["entity_id"] for r in M.paged_list(rows, "nonsense", False, 2, 1).collect()] == ["d", "c"]
    assert {r["entity_id"] for r in M.entity_search(rows, district="D", capacity_min=60, text="p >").collect()} == {"a", "c"}
    nav = {r["entity_id"]: (r["prev_id"], r["next_id"], r["district_count"]) for r in M.sibling_nav(rows).collect()}
    assert nav == {"c": ("b", "a", 3), "a": ("c", "b", 3), "b": ("a", "c", 3), "d": ("d", "d", 1)}


def test_leap_day_has_no_partner(spark):
    rows = series(spark, [(day("2024-02-29"),), (day("2025-02-28"),)], "date date")
    got = [r[0] for r in rows.select(M.same_day_a_year_before(F.col("date"))).collect()]
    assert got == [None, day("2024-02-28")]


@pytest.mark.parametrize("descending", [True, False])
def test_deep_pages_equal_the_sorted_list(spark, descending):
    rng = random.Random(4)
    rows = [(f"e{i:05}", None if rng.random() < 0.2 else float(rng.randint(0, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "entity_id string, train_mean double").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else (-r[1] if descending else r[1]), r[0]))
    for offset, limit in ((0, 20), (190, 30), (1500, 400), (2990, 50), (5000, 5)):
        got = [tuple(r) for r in M.paged_list(df, "train_mean", descending, limit, offset, shallow=200).collect()]
        assert got == ordered[offset : offset + limit]


def test_a_replayed_batch_changes_nothing_and_fetched_days_are_skipped(spark, tmp_path):
    schema = "kind string, province string, date date, outage_id int, version int, reason string"
    first = series(spark, [("k", "P", day("2025-01-01"), 1, 10, "old"), ("k", "P", day("2025-01-01"), 2, 10, "old")], schema)
    second = series(spark, [("k", "P", day("2025-01-03"), 1, 11, "new"), ("k", "P", day("2025-01-03"), 3, 1, "new"), ("k", "P", day("2025-01-03"), 2, 9, "stale")], schema)
    place = "kind string, province string, date date"
    covered = series(spark, [("k", "P", day("2025-01-01")), ("k", "P", day("2025-01-02"))], place)
    store = EventStore(str(tmp_path / "store"), ("kind", "outage_id"), "version", 4)
    assert store.rows(spark) is None and store.ledger(spark).count() == 0
    store.upsert(first, 0, covered)
    store.upsert(second, 1, second.select("kind", "province", "date"))

    def state():
        return {r["outage_id"]: r["reason"] for r in store.rows(spark).collect()}, sorted((str(r["date"]), r["n"]) for r in store.ledger(spark).collect())

    want = {1: "new", 2: "old", 3: "new"}, [("2025-01-01", 2), ("2025-01-02", 0), ("2025-01-03", 3)]
    assert state() == want
    store.upsert(first, 0, covered)
    assert state() == want
    # a crash between the rows and the ledger: the batch runs again as a whole
    shutil.rmtree(tmp_path / "store" / "ledger" / "batch-1")
    store.upsert(second, 1, second.select("kind", "province", "date"))
    assert state() == want
    wanted = series(spark, [("k", "P", day(f"2025-01-0{i}")) for i in range(1, 6)], place)
    assert [str(r["date"]) for r in records(store.missing(wanted), "date")] == ["2025-01-04", "2025-01-05"]
    store.upsert(first.limit(0), 2, wanted.where("date = '2025-01-04'"))
    assert [str(r["date"]) for r in records(store.missing(wanted), "date")] == ["2025-01-05"] and state()[0] == want[0]


def test_a_stream_fills_the_store(spark, tmp_path):
    schema = "kind string, outage_id int, version int"
    for n in range(3):
        series(spark, [("k", i, n) for i in range(n, n + 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = EventStore(str(tmp_path / "store"), ("kind", "outage_id"), "version", 2)
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r["outage_id"]: r["version"] for r in store.rows(spark).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}


def test_deep_pages_take_a_bounded_number_of_ranges(spark, monkeypatch):
    stored, store = [], M.staged
    monkeypatch.setattr(M, "staged", lambda df: stored.append(store(df)) or stored[-1])
    rows = spark.range(3000).selectExpr("CAST(id AS STRING) AS entity_id", "CAST(id AS DOUBLE) AS train_mean")
    page = M.paged_list(rows, "train_mean", False, 3, 1500, shallow=10)
    assert [r["train_mean"] for r in page.collect()] == [1500.0, 1501.0, 1502.0]
    limit = int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    assert stored[-1].select("_range").distinct().count() <= limit
