"""Mascon solutions and their grids. No netCDF or HDF5 library is at hand: the arrays of a file are staged as Parquet rows.

A variable on (time, lat, lon) is rows (time, lat, lon, <variable>), in degrees and days; a group of columns is a table of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import nearest, reuter_grid

#: Fixed value: solutions count their days from this date.
FIRST_DAY = "2002-01-01"


def _longitude(degrees: str) -> Column:
    """Radians from -pi to pi."""
    x = F.radians(degrees)
    return F.when(x > math.pi, x - 2 * math.pi).otherwise(x)


def _epoch(days: Column) -> Column:
    start = F.unix_micros(F.to_timestamp(F.lit(FIRST_DAY)))
    return F.timestamp_micros(start + F.round(days * 86400e6).cast("long")).cast("timestamp_ntz")


def read_mascon_grids(spark: SparkSession, path: str, scale: float = 1e-2, layer: str = "lwe_thickness") -> DataFrame:
    """Rows (epoch, lon, lat, value) of gridded solutions; the scale turns centimetres into metres."""
    rows = spark.read.parquet(path)
    return rows.select(_epoch(F.col("time")).alias("epoch"), _longitude("lon").alias("lon"), F.radians("lat").alias("lat"), (F.col(layer) * scale).alias("value"))


def read_mascons_on_their_grid(spark: SparkSession, path: str, grid: DataFrame, scale: float = 1e-2, layer: str = "lwe_thickness") -> DataFrame:
    """Rows (epoch, point_id, value) of gridded solutions at the points (point_id, lon, lat) on which they were estimated.

    Each point takes the values of the nearest point of the finer grid that is delivered.
    """
    values = read_mascon_grids(spark, path, scale, layer)
    cells = values.select("lon", "lat").distinct().withColumn("point_id", F.xxhash64("lon", "lat"))
    near = nearest(grid.select("point_id", "lon", "lat"), cells).select("point_id", "target_id")
    placed = values.join(cells.withColumnRenamed("point_id", "target_id"), ["lon", "lat"])
    return near.join(placed, "target_id").select("epoch", "point_id", "value")


def read_mascon_solutions(spark: SparkSession, mascons: str, times: str, solution: str, scale: float = 1e-2, layer: str = "cmwe") -> tuple[DataFrame, DataFrame]:
    """Points (point_id, lon, lat, area) and values (epoch, point_id, value) of solutions on their own mascons.

    mascons: rows (mascon, lon_center, lat_center, area_km2), times: (step, ref_days_middle), solution: (mascon, step,
    <layer>). Day 1 is the first; areas are shares of the unit sphere's.
    """
    rows = spark.read.parquet(mascons)
    total = rows.agg(F.sum("area_km2")).first()[0] or 1.0
    points = rows.select(F.col("mascon").alias("point_id"), _longitude("lon_center").alias("lon"), F.radians("lat_center").alias("lat"), (F.col("area_km2") / total * 4 * math.pi).alias("area"))
    epochs = spark.read.parquet(times).select("step", _epoch(F.col("ref_days_middle") - 1).alias("epoch"))
    values = spark.read.parquet(solution).join(epochs, "step").select("epoch", F.col("mascon").alias("point_id"), (F.col(layer) * scale).alias("value"))
    return points, values


def mascon_grid(spark: SparkSession, points: str, corners: str) -> tuple[DataFrame, DataFrame]:
    """A grid whose cells are polygons: points (point_id, lon, lat, area) and corners (point_id, seq, lon, lat), in radians, as staged."""
    return spark.read.parquet(points).select("point_id", "lon", "lat", "area"), spark.read.parquet(corners).select("point_id", "seq", "lon", "lat")


def mascon_rectangles(spark: SparkSession, points: str) -> DataFrame:
    """Points with west, east, south and north of their cells, out of staged rows (point_id, lon, lat, area, width, height), in radians.

    A cell that reaches over a pole is half as high, about the same middle.
    """
    half = math.pi / 2
    rows = spark.read.parquet(points)
    over = (F.col("lat") - F.col("height") / 2 < -half) | (F.col("lat") + F.col("height") / 2 > half)
    height = F.when(over, F.col("height") / 2).otherwise(F.col("height"))
    return rows.select("point_id", "lon", "lat", "area", (F.col("lon") - F.col("width") / 2).alias("west"), (F.col("lon") + F.col("width") / 2).alias("east"), (F.col("lat") - height / 2).alias("south"), (F.col("lat") + height / 2).alias("north"))


def reuter_mascons(spark: SparkSession, level: int = 60) -> DataFrame:
    """Mascons of equal height on the parallels of a Reuter grid on the sphere, as wide as their parallel allows; one at each pole."""
    step, grid = math.pi / level, reuter_grid(spark, level, f=0.0)
    width = 2 * math.pi / F.when(F.col("i_lat").isin(0, level), 1).otherwise(F.col("_count"))
    counts = grid.groupBy("i_lat").agg(F.count("*").alias("_count"))
    placed = grid.join(counts, "i_lat").withColumn("_width", width)
    return placed.select("i_lat", "i_lon", "lon", "lat", "area", (F.col("lon") - F.col("_width") / 2).alias("west"), (F.col("lon") + F.col("_width") / 2).alias("east"), (F.col("lat") - step / 2).alias("south"), (F.col("lat") + step / 2).alias("north"))


def read_order_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Normal matrices by order, rows (m, trig, i, j, v), out of staged arrays (name, row, column, value) named order3_cos, order3_sin and so on.

    i and j are degrees: an order's first row stands for its own order, that of order 0 for degree 0.
    """
    rows = spark.read.parquet(path)
    m = F.regexp_extract("name", r"^order(\d+)_(cos|sin)$", 1).try_cast("int")
    trig = F.when(F.regexp_extract("name", r"_(cos|sin)$", 1) == "sin", 1).otherwise(0)
    found = rows.select(m.alias("m"), trig.alias("trig"), "row", "column", F.col("value").alias("v")).where("m is not null")
    return found.select("m", "trig", (F.col("row") + F.col("m")).cast("long").alias("i"), (F.col("column") + F.col("m")).cast("long").alias("j"), "v")
