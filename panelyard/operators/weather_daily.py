"""Trailing weather windows per district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.weather import floor_zero, vapour_pressure_deficit, weather_basic


def trailing(days: int):
    """The current and the ``days - 1`` rows before it, per district."""
    return Window.partitionBy("district").orderBy("date").rowsBetween(1 - days, Window.currentRow)


def weather_rolling(weather: DataFrame) -> DataFrame:
    """Means, sums and counts over 3, 7, 14 and 30 rows; needs the columns of ``weather_basic``.

    Weather is unique by district and day, so a window partition is one district's calendar. All frames
    share one sort.
    """
    mean, hottest = F.col("temperature_2m_mean"), F.col("temperature_2m_max")
    et0, rain = F.col("et0_fao_evapotranspiration"), F.col("rain_sum")
    deficit = floor_zero(et0 - F.col("precipitation_sum"))
    vpd = vapour_pressure_deficit(mean, F.col("relative_humidity_2m_mean"))

    def total(x: Column, days: int) -> Column:
        return F.sum(x).over(trailing(days))

    def level(x: Column, days: int) -> Column:
        return F.avg(x).over(trailing(days))

    def count(condition: Column, days: int) -> Column:
        return F.count(F.when(condition, 1)).over(trailing(days))

    return weather.withColumns(
        {
            "tmean_r7": level(mean, 7),
            "cdd_r7": level(F.col("cdd22"), 7),
            "hdd_r7": level(F.col("hdd18"), 7),
            "rad_r7": level(F.col("shortwave_radiation_sum"), 7),
            "vpd_r7": level(vpd, 7),
            "cdd_acc": total(F.col("cdd22"), 14),
            "heat_wave_3d": count(hottest >= 33.0, 3),
            "hot_days_7d": count(hottest >= 30.0, 7),
            "water_deficit_7d": total(deficit, 7),
            "water_deficit_14d": total(deficit, 14),
            "water_deficit_30d": total(deficit, 30),
            "et0_cum_30d": total(et0, 30),
            "rain_cum_30d": total(rain, 30),
            "soil_moist_anom": total(rain, 30) - total(et0, 30),
        }
    )


def days_since_event(df: DataFrame, event: Column, name: str, keys: tuple[str, ...] = ("district",)) -> DataFrame:
    """Rows since the last event, zero on the event row; before any event, rows since the start."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy(*keys, "_spell").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flag = F.coalesce(event, F.lit(False)).cast("int")
    return (
        df.withColumn("_event", flag)
        .withColumn("_spell", F.sum("_event").over(w))
        .withColumn(name, F.sum(1 - F.col("_event")).over(within))
        .drop("_event", "_spell")
    )


def weather_features(raw: DataFrame) -> DataFrame:
    """All derived weather columns."""
    wet = F.col("precipitation_sum") > 0.5
    out = days_since_event(weather_rolling(weather_basic(raw)), wet, "days_since_rain")
    return out.withColumn("dry_spell_len", F.col("days_since_rain"))
