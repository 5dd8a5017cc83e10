"""Row-wise weather columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_zero(x: Column) -> Column:
    """Clip below at zero, keeping NULL (``greatest`` alone would turn NULL into zero)."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def weather_basic(df: DataFrame) -> DataFrame:
    """Degree days, sun hours and daily spreads."""
    mean = F.col("temperature_2m_mean")
    cooling = floor_zero(mean - 22.0)
    return df.withColumns(
        {
            "hdd18": floor_zero(F.lit(18.0) - mean),
            "cdd22": cooling,
            "cdd_log": F.log1p(cooling),
            "sunshine_hours": F.col("sunshine_duration") / 3600.0,
            "daylight_hours": F.col("daylight_duration") / 3600.0,
            "sunshine_ratio": F.try_divide(F.col("sunshine_duration"), F.col("daylight_duration")),
            "apparent_delta": F.col("apparent_temperature_mean") - mean,
            "temp_range": F.col("temperature_2m_max") - F.col("temperature_2m_min"),
        }
    )


def vapour_pressure_deficit(t: Column, rh: Column) -> Column:
    """Magnus saturation pressure (kPa) times the missing humidity share."""
    return 0.61078 * F.exp(17.27 * t / (t + 237.3)) * (1 - rh / 100)


def dew_point(t: Column, rh: Column) -> Column:
    """Magnus dew point in degrees Celsius; humidity is floored at one percent."""
    # Magnus coefficients for water, degrees Celsius.
    a, b = 17.27, 237.7
    humid = F.when(rh < 1, F.lit(1.0)).otherwise(rh)
    gamma = a * t / (b + t) + F.log(humid / 100)
    return b * gamma / (a - gamma)


def wind_chill(t: Column, wind_ms: Column) -> Column:
    """Joint Action Group formula; wind arrives in m/s and the formula wants km/h."""
    power = F.pow(floor_zero(wind_ms * 3.6), F.lit(0.16))
    return 13.12 + 0.6215 * t - 11.37 * power + 0.3965 * t * power


# Rothfusz heat-index coefficients for degrees Celsius, by (power of t, power of rh).
HEAT_INDEX = {
    (0, 0): -8.784695,
    (1, 0): 1.61139411,
    (0, 1): 2.338549,
    (1, 1): -0.14611605,
    (2, 0): -0.012308094,
    (0, 2): -0.016424828,
    (2, 1): 0.002211732,
    (1, 2): 0.00072546,
    (2, 2): -0.000003582,
}


def heat_index(t: Column, rh: Column) -> Column:
    total = F.lit(0.0)
    for (p, q), weight in HEAT_INDEX.items():
        term = F.lit(weight)
        for _ in range(p):
            term = term * t
        for _ in range(q):
            term = term * rh
        total = total + term
    return total


def weather_physics(df: DataFrame) -> DataFrame:
    """Dew point, wind chill, heat index, gust excess and five interactions."""
    t, rh = F.col("temperature_2m_mean"), F.col("relative_humidity_2m_mean")
    wind, sun = F.col("wind_speed_10m_mean"), F.col("shortwave_radiation_sum")
    return df.withColumns(
        {
            "dew_point": dew_point(t, rh),
            "wind_chill": wind_chill(t, wind),
            "heat_index": heat_index(t, rh),
            "gust_excess": F.col("wind_gusts_10m_max") - wind,
            "temp_humidity": t * rh / 100,
            "temp_wind": t * wind,
            "solar_temp": sun * t,
            "cloud_humidity": F.col("cloud_cover_mean") * rh,
            "rain_sun_opposition": -sun * F.col("precipitation_sum"),
        }
    )
