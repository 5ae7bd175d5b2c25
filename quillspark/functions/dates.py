"""Epidemiological weeks and the calendar (P06-P09). A week runs Sunday to Saturday; week 1 holds 4 January."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _midweek(d: Column) -> Column:
    """The Wednesday of the date's week, whose calendar year is the week's year."""
    return F.date_add(d, 4 - F.dayofweek(d))


def epi_year(d: Column) -> Column:
    return F.year(_midweek(d)).cast("smallint")


def epi_week(d: Column) -> Column:
    return (F.floor((F.dayofyear(_midweek(d)) - 1) / 7) + 1).cast("tinyint")


def epi_week_of(d: dt.date) -> tuple[int, int]:
    """(year, week) of one date, the definition as a scalar."""
    mid = d + dt.timedelta(days=3 - (d.isoweekday() % 7))
    return mid.year, (mid.timetuple().tm_yday - 1) // 7 + 1


def weeks_in(year: Column) -> Column:
    """52 or 53 (P08)."""
    last = F.make_date(year, F.lit(12), F.lit(31))
    return F.when(epi_year(last) == year, epi_week(last)).otherwise(epi_week(F.date_sub(last, 7))).cast("int")


def calendar(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    """One row a day: date, year, month, competence, epi_year, epi_week."""
    first = dt.date(start_year, 1, 1)
    n = (dt.date(end_year, 12, 31) - first).days + 1
    d = F.date_add(F.lit(first), F.col("id").cast("int"))
    return spark.range(n).select(d.alias("date"), F.year(d).alias("year"), F.month(d).alias("month"), (F.year(d) * 100 + F.month(d)).alias("competence"), epi_year(d).alias("epi_year"), epi_week(d).alias("epi_week"))
