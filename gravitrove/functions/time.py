"""Modified Julian dates, decimal years and GPS weeks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modified Julian Date of 1970-01-01 and of the GPS epoch 1980-01-06.
UNIX_MJD, GPS_MJD = 40587, 44244


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mjd(ts: str | Column) -> Column:
    """Whole seconds count; fractions of a second are dropped."""
    t = _col(ts)
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.unix_date(t.cast("date")) + F.lit(float(UNIX_MJD)) + seconds / F.lit(86400.0)


def from_mjd(day: str | Column) -> Column:
    return F.timestamp_seconds((_col(day) - UNIX_MJD) * 86400.0)


def decimal_year(ts: str | Column) -> Column:
    """Year and the elapsed share of its days, in whole days."""
    t = _col(ts)
    start = F.make_date(F.year(t), F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(F.year(t) + 1, F.lit(1), F.lit(1)), start)
    return F.year(t) + F.datediff(t.cast("date"), start) / length


def gps_week_day(ts: str | Column) -> tuple[Column, Column]:
    days = F.unix_date(_col(ts).cast("date")) + UNIX_MJD - GPS_MJD
    return F.floor(days / 7), F.pmod(days, F.lit(7))


def gps_week_seconds(ts: str | Column) -> tuple[Column, Column]:
    t = _col(ts)
    week, day = gps_week_day(t)
    return week, day * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def decimal_year_to_mjd(year: str | Column) -> Column:
    y = _col(year)
    start, end = (F.unix_date(F.make_date(F.floor(y).cast("int") + k, F.lit(1), F.lit(1))) for k in (0, 1))
    return start + UNIX_MJD + (y - F.floor(y)) * (end - start)


def gps_week_day_to_date(week: str | Column, day: str | Column) -> Column:
    return F.date_add(F.lit("1980-01-06").cast("date"), (_col(week) * 7 + _col(day)).cast("int"))
