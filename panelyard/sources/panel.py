"""Panel, weather and coordinate readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.rounding import rounded
from panelyard.functions.text import day_label, parse_location
from panelyard.operators.clean import declip

# Column names of the public panel export and their engine names.
PANEL_COLUMNS = {
    "id": "id", "tanim": "entity_id", "guc": "capacity", "tarih": "date", "tuketim": "value", "lokasyon": "location",
}
DROPPED_WEATHER = ("uv_index_max", "uv_index_clear_sky_max")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, or parquet, by the path's ending. Without a schema every CSV column is text."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL: aggregates skip NULL but not NaN."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def read_panel(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Daily readings with parsed location, log value and activity flag; a test file has no value column."""
    raw = read_table(spark, path)
    present = {src: dst for src, dst in PANEL_COLUMNS.items() if src in raw.columns}
    named = raw.select([F.col(s).alias(d) for s, d in present.items()])
    typed = named.withColumns(
        {
            "entity_id": F.col("entity_id").cast("string"),
            "capacity": F.col("capacity").try_cast("double"),
            "date": F.substring(F.col("date").cast("string"), 1, 10).try_cast("date"),
        }
    )
    return prepare_panel(typed, clean)


def prepare_panel(typed: DataFrame, clean: bool = True) -> DataFrame:
    """Repair, location, log value and activity flag for rows with engine column names."""
    if "value" not in typed.columns:
        return parse_location(typed)
    out = nan_to_null(typed.withColumn("value", F.col("value").try_cast("double")))
    out = parse_location(declip(out) if clean else out)
    return out.withColumns({"log_value": F.log1p("value"), "is_pos": (F.col("value") > 0).cast("int")})


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """District-day weather; two ultraviolet columns are dropped when present."""
    raw = read_table(spark, path)
    raw = raw.drop(*DROPPED_WEATHER).withColumnsRenamed({"ilce": "district", "tarih": "date"})
    measures = [c for c in raw.columns if c not in ("district", "date")]
    return nan_to_null(
        raw.withColumns({"date": F.substring("date", 1, 10).try_cast("date"), **{c: F.col(c).try_cast("double") for c in measures}})
    )


def serving_weather(weather: DataFrame) -> DataFrame:
    """Rounded columns the serving tables show."""
    digits = {
        "temp_mean": ("temperature_2m_mean", 2), "temp_min": ("temperature_2m_min", 2), "temp_max": ("temperature_2m_max", 2),
        "apparent_temp": ("apparent_temperature_mean", 2), "humidity": ("relative_humidity_2m_mean", 1),
        "precipitation": ("precipitation_sum", 2),
    }
    return weather.withColumns({"day_label": day_label(F.col("date")), **{n: rounded(c, d) for n, (c, d) in digits.items()}})


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """JSON map name -> [lat, lon] as rows district, lat, lon; entries of any other shape are NULL."""
    text = spark.read.text(path, wholetext=True)
    return coords_rows(text, "value")


def coords_rows(df: DataFrame, column: str) -> DataFrame:
    pairs = F.explode(F.from_json(column, "map<string, array<double>>")).alias("district", "pair")
    return df.select(pairs).select("district", F.get("pair", F.lit(0)).alias("lat"), F.get("pair", F.lit(1)).alias("lon"))


def geo_attach(df: DataFrame, coords: DataFrame) -> DataFrame:
    """District coordinates; unknown districts stay NULL."""
    return df.join(coords.select("district", "lat", "lon"), "district", "left")
