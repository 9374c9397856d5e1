"""Rows of epochs; the end is never included."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _time(x: dt.datetime) -> Column:
    return F.lit(x).cast("timestamp_ntz")


def epochs(spark: SparkSession, start: dt.datetime, stop: dt.datetime, step: dt.timedelta) -> DataFrame:
    """start, start + step, ... before stop (after it for a negative step)."""
    if not step:
        raise ValueError("the step of a sequence of epochs can't be zero")
    count = max(0, -((start - stop) // step))
    micros = step // dt.timedelta(microseconds=1)
    return spark.range(count).select((_time(start) + F.make_dt_interval(secs=(F.col("id") * F.lit(micros) / 1e6).cast("decimal(18,6)"))).alias("epoch"))


def years(spark: SparkSession, start: dt.datetime, stop: dt.datetime, middle: bool = False) -> DataFrame:
    """First of January, or the middle of the year, from start's year on."""
    first = spark.range(start.year, stop.year + 1).select(F.make_date(F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("day"))
    half = F.datediff(F.add_months("day", 12), F.col("day")) * 12 if middle else F.lit(0)
    return _before(first, half, stop)


def months(spark: SparkSession, start: dt.datetime, stop: dt.datetime, middle: bool = False) -> DataFrame:
    """First of the month, or the day nearest half its length, from start's month on; it may lie before start."""
    count = (stop.year - start.year) * 12 + stop.month - start.month + 1
    first = spark.range(max(0, count)).select(F.add_months(F.lit(start.date().replace(day=1)), F.col("id").cast("int")).alias("day"))
    half = (F.bround(F.dayofmonth(F.last_day("day")) / 2) - 1) * 24 if middle else F.lit(0)
    return _before(first, half, stop)


def days(spark: SparkSession, start: dt.datetime, stop: dt.datetime, middle: bool = False) -> DataFrame:
    """Midnight, or noon, of each day from start's day on."""
    first = spark.range(max(0, (stop.date() - start.date()).days + 1)).select(F.date_add(F.lit(start.date()), F.col("id").cast("int")).alias("day"))
    return _before(first, F.lit(12 if middle else 0), stop)


def _before(first: DataFrame, hours: Column, stop: dt.datetime) -> DataFrame:
    epoch = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=hours.cast("int"))
    return first.select(epoch.alias("epoch")).where(F.col("epoch") < _time(stop))
