"""Percentages, bands and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """0 where there is nothing to cover."""
    return F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole)


def main_percent(part: Column, whole: Column) -> Column:
    """Rounded half up to one decimal."""
    return F.when(whole == 0, 0.0).otherwise(F.floor(part * 1000.0 / whole + 0.5) / 10.0)


def priority(covered: Column, total: Column) -> Column:
    """High below 50 %, Low above 80 %, else Medium; none where there is nothing to cover."""
    return F.when(total == 0, "").when(covered * 100 < total * 50, "High").when(covered * 100 > total * 80, "Low").otherwise("Medium")


#: The names of grades, the lowest first (fixed values).
GRADES = ("needs work", "acceptable", "commendable", "exemplary")


def grade(share: Column, bands: tuple[float, float, float] = (60.0, 75.0, 90.0)) -> Column:
    """The name of a percentage; bands: the lower edges of all grades but the lowest."""
    named = F.lit(GRADES[0])
    for name, edge in zip(GRADES[1:], bands):
        named = F.when(share >= edge, name).otherwise(named)
    return named
