"""Season arithmetic: a season runs from July to June."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_MONTH = 7
CENTURY_PIVOT = 90


def start_year(date: str | Column, month: int = START_MONTH) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.year(d) - F.when(F.month(d) < month, 1).otherwise(0)


def code(date: str | Column) -> Column:
    """`YYZZ`, e.g. 9596."""
    y = start_year(date)
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    return F.concat(two(y), two(y + 1))


def label(start: Column) -> Column:
    """`2024-25`."""
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def code_years(season: Column) -> tuple[Column, Column]:
    """Calendar years of a `YYZZ` code; two digits from the pivot on are 19xx."""
    def full(part: Column) -> Column:
        n = part.cast("int")
        return n + F.when(n >= CENTURY_PIVOT, 1900).otherwise(2000)

    return full(F.substring(season, 1, 2)), full(F.substring(season, 3, 2))
