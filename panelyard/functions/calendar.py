"""Calendar, holiday and spline columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HolidayCalendar:
    """Holiday dates as parameters; each list is short and known on the driver."""

    fixed: Sequence[tuple[int, int]]
    ramadan: Sequence[str]
    sacrifice: Sequence[str]
    eve: Sequence[str]

    @property
    def feast(self) -> list[str]:
        return sorted({*self.ramadan, *self.sacrifice})

    @property
    def feast_and_eve(self) -> list[str]:
        return sorted({*self.ramadan, *self.sacrifice, *self.eve})


# Official holidays as (month, day) and lunar feast days of 2025 and 2026.
TURKEY = HolidayCalendar(
    fixed=((1, 1), (4, 23), (5, 1), (5, 19), (7, 15), (8, 30), (10, 29)),
    ramadan=("2025-03-30", "2025-03-31", "2025-04-01", "2026-03-20", "2026-03-21", "2026-03-22"),
    sacrifice=(
        "2025-06-06", "2025-06-07", "2025-06-08", "2025-06-09",
        "2026-05-27", "2026-05-28", "2026-05-29", "2026-05-30",
    ),
    eve=("2025-03-29", "2025-06-05", "2026-03-19", "2026-05-26"),
)

# First and last day of year of the school summer break.
SCHOOL_BREAK = (166, 258)


def in_dates(date: Column, days: Sequence[str]) -> Column:
    """Membership in a literal list of ISO dates (an IN-set, pushed to the scan)."""
    if not days:
        return F.lit(False)
    return date.isin([F.to_date(F.lit(d)) for d in days])


def calendar_features(df: DataFrame, holidays: HolidayCalendar = TURKEY, date: str = "date") -> DataFrame:
    """Month, weekday, day of year, cyclic forms, holiday flags and school break."""
    day = F.col(date)
    month, dow, doy = F.month(day), F.weekday(day), F.dayofyear(day)
    fixed = F.lit(False)
    for m, d in holidays.fixed:
        fixed = fixed | ((month == m) & (F.dayofmonth(day) == d))
    ramadan, sacrifice = in_dates(day, holidays.ramadan), in_dates(day, holidays.sacrifice)
    start, end = SCHOOL_BREAK
    in_break = doy.between(start, end)

    def wave(x: Column, period: float, fn) -> Column:
        return fn(x * (2 * math.pi) / period)

    return df.withColumns(
        {
            "month": month,
            "dow": dow,
            "doy": doy,
            "is_weekend": (dow >= 5).cast("int"),
            "doy_sin": wave(doy, 365.25, F.sin),
            "doy_cos": wave(doy, 365.25, F.cos),
            "month_sin": wave(month, 12.0, F.sin),
            "month_cos": wave(month, 12.0, F.cos),
            "dow_sin": wave(dow, 7.0, F.sin),
            "dow_cos": wave(dow, 7.0, F.cos),
            "is_holiday": (fixed | ramadan | sacrifice).cast("int"),
            "is_ramadan_feast": ramadan.cast("int"),
            "is_sacrifice_feast": sacrifice.cast("int"),
            "is_eve": in_dates(day, holidays.eve).cast("int"),
            "is_school_holiday": in_break.cast("int"),
            "days_into_summer_break": F.when(in_break, doy - start).otherwise(0),
        }
    )


def calendar_extra(df: DataFrame, date: str = "date") -> DataFrame:
    """Year, quarter, day of month, season (0 = winter) and period edge flags."""
    day = F.col(date)
    tomorrow = F.date_add(day, 1)
    edges = {}
    for unit in ("month", "quarter", "year"):
        edges[f"is_{unit}_start"] = (F.trunc(day, unit) == day).cast("int")
        edges[f"is_{unit}_end"] = (F.trunc(tomorrow, unit) == tomorrow).cast("int")
    return df.withColumns(
        {
            "year": F.year(day),
            "quarter": F.quarter(day),
            "day_of_month": F.dayofmonth(day),
            "season": F.floor((F.month(day) % 12) / 3).cast("int"),
            **edges,
        }
    )


def quadratic_basis(x: Column, low: float, high: float, prefix: str) -> dict[str, Column]:
    """Degree-2 B-spline basis with one interval on [low, high]; the three columns sum to one."""
    u = (x - low) / (high - low)
    return {
        f"{prefix}_sp_0": (1 - u) * (1 - u) / 2,
        f"{prefix}_sp_1": (1 + 2 * u - 2 * u * u) / 2,
        f"{prefix}_sp_2": u * u / 2,
    }


def spline_features(df: DataFrame, date: str = "date") -> DataFrame:
    day = F.col(date)
    return df.withColumns(
        {
            **quadratic_basis(F.dayofyear(day), 1, 366, "doy"),
            **quadratic_basis(F.dayofmonth(day), 1, 31, "dom"),
            **quadratic_basis(F.weekday(day), 0, 6, "dow"),
        }
    )
