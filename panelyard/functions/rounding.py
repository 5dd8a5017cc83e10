"""Rounding that does not depend on summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nudge(digits: int) -> float:
    """Far below the last kept digit."""
    return 10.0 ** -(digits + 3)


def rounded(x: Column | str, digits: int) -> Column:
    """Round half up after a nudge: a mean that is a tie up to floating noise always rounds the same way,
    whatever the order in which its terms were added."""
    column = F.col(x) if isinstance(x, str) else x
    return F.round(column.cast("double") + nudge(digits), digits)
