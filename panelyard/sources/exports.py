"""Semicolon exports with local numerals: hourly series, monthly province tables, outage tables, reports."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.text import period_norm, tr_date, tr_month, tr_number
from panelyard.operators.scale import keep_one

# Header names of the public exports and their engine names.
REALTIME_USE = {"Tarih": "date", "Saat": "hour", "Tüketim Miktarı(MWh)": "value"}
LOAD_PLAN = {"Tarih": "date", "Saat": "hour", "Yük Tahmin Planı (MWh)": "value"}
REALTIME_GENERATION = {
    "Tarih": "date", "Saat": "hour", "Toplam": "total", "Doğal Gaz": "gas", "Barajlı": "dam", "Linyit": "lignite",
    "Akarsu": "river", "İthal Kömür": "import_coal", "Rüzgar": "wind", "Güneş": "solar", "Fuel Oil": "fuel_oil",
    "Jeotermal": "geothermal", "Asfaltit Kömür": "asphaltite", "Taş Kömür": "hard_coal", "Biyokütle": "biomass",
    "Nafta": "naphtha", "LNG": "lng", "Uluslararası": "international", "Atık Isı": "waste_heat",
}
GENERATION_PLAN = {
    "Tarih": "date", "Saat": "hour", "Toplam(MWh)": "total", "Doğalgaz": "gas", "Rüzgar": "wind", "Linyit": "lignite",
    "Taş Kömür": "hard_coal", "İthal Kömür": "import_coal", "Fueloil": "fuel_oil", "Jeotermal": "geothermal",
    "Barajlı": "dam", "Nafta": "naphtha", "Biyokütle": "biomass", "Akarsu": "river", "Gunes": "solar", "Diğer": "other",
}
PROVINCE_SEGMENTS = {
    "Aydınlatma (MWh)": "lighting", "Mesken (MWh)": "residential", "Sanayi (MWh)": "industry",
    "Tarımsal Sulama (MWh)": "irrigation", "Ticarethane (MWh)": "commerce", "Diğer (MWh)": "other",
    "Genel Toplam (MWh)": "total", "İl Bazında Tüketim Oranı (%)": "province_share_pct",
}
HEADLINE_KEYS = ("smape", "cv_mean", "mean_smape", "val_smape", "score", "verdict", "best_score", "lb")


def clean_header(name: str) -> str:
    return name.replace("﻿", "").strip()


def plain_path(uri: Column | str) -> Column:
    """The path of a file as given to a reader, from its URI."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def headers(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> dict[str, list[str]]:
    """Files by their header line, read in one job: the first line of a file is the first of its first block."""
    lines = spark.read.option("encoding", encoding).text(list(paths)).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value"
    )
    first = lines.where(F.col("start") == 0).groupBy("path").agg(F.min_by("value", "line").alias("header"))
    out: dict[str, list[str]] = {}
    for row in sorted(first.collect()):  # one row per file of a list the caller holds
        out.setdefault(row["header"], []).append(row["path"])
    return out


def read_exports(spark: SparkSession, paths: Sequence[str], sep: str = ";") -> DataFrame:
    """Union of text exports whose headers may differ, with ``source_file``, the path. One scan per distinct header."""
    if not paths:
        raise FileNotFoundError("no export files given")
    out = None
    for header, files in headers(spark, paths).items():
        columns = [c.strip('"') for c in header.split(sep)]
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns))])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", "UTF-8").csv(files)
        named = raw.select(
            *[F.col(f"_{i}").alias(clean_header(c)) for i, c in enumerate(columns) if clean_header(c)], F.col("_metadata.file_path").alias("source_file")
        )
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("the export files are empty")
    return out


def hour_number(text: Column) -> Column:
    return F.substring(F.trim(text), 1, 2).try_cast("int")


def hourly_series(raw: DataFrame, columns: Mapping[str, str], keep: str = "first") -> DataFrame:
    """Rename, parse numerals and keep one row per (date, hour): the one of the first (or last) file.

    Only mapped columns that exist are read.
    """
    present = {s: d for s, d in columns.items() if s in raw.columns}
    named = raw.select("source_file", *[F.col(f"`{s}`").alias(d) for s, d in present.items()])
    values = [d for d in present.values() if d not in ("date", "hour")]
    typed = named.withColumns(
        {"date": tr_date(F.col("date")), "hour": hour_number(F.col("hour")), **{v: tr_number(F.col(v)) for v in values}}
    )
    picked = keep_one(typed, ["date", "hour"], F.col("source_file"), largest=keep == "last")
    return picked.select("date", "hour", *values)


def value_column(columns: Sequence[str]) -> str:
    """The one measure of a load-plan export: its header names a load or MWh."""
    return next(c for c in columns if "Yük" in c or "MWh" in c)


def read_hourly_export(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    raw = read_exports(spark, paths)
    return hourly_series(raw, {"Tarih": "date", "Saat": "hour", value_column(raw.columns): "value"})


def read_hourly_mapped(spark: SparkSession, paths: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    return hourly_series(read_exports(spark, paths), columns)


def province_monthly(raw: DataFrame) -> DataFrame:
    """Province x month table: the last file wins, and monthly MWh become a daily rate.

    ``raw`` carries province, source_file, the period text and whichever segment columns exist.
    """
    values = {
        d: tr_number(F.col(f"`{s}`")) if s in raw.columns else F.lit(None).cast("double")
        for s, d in PROVINCE_SEGMENTS.items()
    }
    rows = raw.select("province", "source_file", tr_month(F.col("Dönem")).alias("month"), *[c.alias(n) for n, c in values.items()])
    unique = keep_one(rows, ["province", "month"], F.col("source_file"), largest=True).drop("source_file")
    days = F.dayofmonth(F.last_day("month"))
    return unique.withColumns(
        {
            "year": F.year("month"),
            "month_no": F.month("month"),
            "days": days,
            "daily_mean": F.col("total") / days,
        }
    )


def read_province_monthly(spark: SparkSession, paths: Mapping[str, Sequence[str]]) -> DataFrame:
    """Exports of several provinces; all files are read together, and a file's folder or path names its province."""
    raw = read_exports(spark, [file for files in paths.values() for file in files])
    province = F.lit(None).cast("string")
    for name, files in paths.items():
        for file in files:
            place = plain_path("source_file")
            province = F.when(F.contains(place, F.lit(file.rstrip("/") + "/")) | F.endswith(place, F.lit(file)), F.lit(name)).otherwise(province)
    return province_monthly(raw.withColumn("province", province))


def province_periods(raw: DataFrame) -> DataFrame:
    """The variant with a city column and ``m.yyyy`` or ``d.m.yyyy`` periods; the first file wins."""
    present = {s: d for s, d in PROVINCE_SEGMENTS.items() if s in raw.columns}
    rows = raw.select(
        "source_file",
        period_norm(F.col("Dönem")).alias("period"),
        F.upper(F.trim("Şehir")).alias("city"),
        *[tr_number(F.col(f"`{s}`")).alias(d) for s, d in present.items()],
    )
    return keep_one(rows, ["city", "period"], F.col("source_file")).drop("source_file")


def read_json_reports(spark: SparkSession, path: str, keys: Sequence[str] = HEADLINE_KEYS) -> DataFrame:
    """One row per JSON file: size, time, first present headline key and its value, raw text.

    A file that is not JSON is skipped.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("content"),
    )
    return json_headlines(raw, keys)


def json_headlines(raw: DataFrame, keys: Sequence[str] = HEADLINE_KEYS) -> DataFrame:
    found = {k: F.get_json_object("content", f"$.{k}") for k in keys}
    key = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in found.items()])
    readable = F.try_parse_json("content").isNotNull()
    return raw.where(readable).withColumns({"headline_metric": key, "headline_value": F.coalesce(*found.values())})


def upsert_events(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest row per key by ``version``; incoming wins a tie."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_one(rows, keys, F.col(version), F.col("_new"), largest=True).drop("_new")


def fetch_ledger(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """(kind, province, day) not fetched yet; a fetched day without rows is in the ledger, so it is skipped."""
    return wanted.join(fetched, ["kind", "province", "date"], "left_anti")


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """First 12 hex digits of sha1("size:mtime") of one file, or "missing"."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return "missing"
    status = fs.getFileStatus(target)
    text = f"{status.getLen()}:{status.getModificationTime() * 1_000_000}"
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def source_fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, files, rows, bytes, print) of file-backed tables: 12 hex digits of a digest over their files' sizes and times.

    One scan of each table's metadata columns; files are reduced by aggregates, in the order of their paths.
    """
    out = None
    for name, df in tables.items():
        facts = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("time"))
        files = facts.groupBy("path", "size", "time").agg(F.count("*").alias("rows"))
        stamp = F.concat_ws(":", F.col("size").cast("string"), F.unix_micros("time").cast("string"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", stamp.alias("stamp")))), lambda f: f["stamp"]), "|")
        row = files.agg(F.lit(name).alias("table_name"), F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("size").alias("bytes"), F.substring(F.sha1(listed.cast("binary")), 1, 12).alias("print"))
        out = row if out is None else out.unionByName(row)
    return out
