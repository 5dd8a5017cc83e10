"""Locale-aware text, number and date parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters folded to ASCII, in alphabetical order, lower case then upper case.
ACCENTED = "çğıöşüâîûÇĞİÖŞÜÂÎÛ"
PLAIN = "cgiosuaiuCGIOSUAIU"

# Three-letter weekday names, Monday first.
WEEKDAY_NAMES = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def location_levels(location: Column) -> Column:
    """Trimmed parts of a ``'>'``-delimited hierarchy."""
    return F.transform(F.split(location, ">"), lambda part: F.trim(part))


def parse_location(df: DataFrame, column: str = "location", missing_region: Column | None = None) -> DataFrame:
    """Add province (first level), region and district (leaf).

    Two levels: the second is the district and the region repeats the province. Three or more: second is
    the region, third the district. One level: the province stands in for all three, unless
    ``missing_region`` gives another region for it (the serving tables use an empty string).
    """
    parts = location_levels(F.col(column))
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    lone_region = first if missing_region is None else missing_region
    return df.withColumns(
        {
            "province": first,
            "region": F.when(F.size(parts) >= 3, second).when(F.size(parts) == 1, lone_region).otherwise(first),
            "district": F.coalesce(third, second, first),
        }
    )


def tr_number(text: Column) -> Column:
    """``'1.222.817,98'`` to 1222817.98; anything unreadable is NULL."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def tr_date(text: Column) -> Column:
    """``dd.MM.yyyy`` with an optional time behind a blank; anything unreadable is NULL."""
    day = F.get(F.split(F.trim(text), " "), F.lit(0))
    return F.try_to_timestamp(day, F.lit("d.M.yyyy")).cast("date")


def tr_month(text: Column) -> Column:
    """``MM.yyyy`` to the first day of that month."""
    return F.try_to_timestamp(F.concat(F.lit("1."), F.trim(text)), F.lit("d.M.yyyy")).cast("date")


def period_norm(text: Column) -> Column:
    """``m.yyyy`` or ``d.m.yyyy`` to ``yyyy-MM``; other shapes stay as they are."""
    parts = F.split(F.trim(text), r"\.")
    size = F.size(parts)
    month = F.get(parts, size - 2).try_cast("int")
    year = F.get(parts, size - 1).try_cast("int")
    return F.when(size.isin(2, 3), F.format_string("%04d-%02d", year, month)).otherwise(F.trim(text))


def tr_upper(text: Column) -> Column:
    """Upper case with dotted and dotless I folded into one capital ``İ``."""
    dotted = F.replace(F.replace(F.replace(text, F.lit("ı"), F.lit("i")), F.lit("I"), F.lit("i")), F.lit("i"), F.lit("İ"))
    return F.trim(F.upper(dotted))


def norm_place(text: Column) -> Column:
    """Upper case, punctuation to blanks, runs of blanks collapsed."""
    words = F.regexp_replace(tr_upper(text), r"[^\p{L}\p{N}_ ]", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def deaccent(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def day_label(date: Column) -> Column:
    """``dd-MM (mon)``."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.concat(F.date_format(date, "dd-MM"), F.lit(" ("), F.get(names, F.weekday(date)), F.lit(")"))


def numeric_id(entity: Column) -> Column:
    """First run of digits in an identifier, NULL if there is none."""
    return F.regexp_extract(entity, r"(\d+)", 1).try_cast("bigint")
