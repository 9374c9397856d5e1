"""Basins on the sphere: rows (basin_id, ring, seq, lon, lat), edges of great circles, each ring within a hemisphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geodesy import A, FLATTENING, geodetic_to_cartesian

RING = ["basin_id", "ring"]


def from_extent(spark: SparkSession, basin_id: int, west: float, south: float, east: float, north: float) -> DataFrame:
    corners = [(west, south), (west, north), (east, north), (east, south)]
    return spark.createDataFrame([(basin_id, 0, k, *map(float, c)) for k, c in enumerate(corners)], "basin_id int, ring int, seq int, lon double, lat double")


def bounding_boxes(rings: DataFrame) -> DataFrame:
    return rings.groupBy("basin_id").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def _unit(lon, lat, f: float) -> tuple[Column, ...]:
    x, y, z = geodetic_to_cartesian(lon, lat, 0.0, A, f)
    length = F.sqrt(x * x + y * y + z * z)
    return x / length, y / length, z / length


def _at(name: str) -> tuple[Column, ...]:
    return tuple(F.col(name + c) for c in "xyz")


def _named(name: str, vector) -> dict[str, Column]:
    return {name + c: v for c, v in zip("xyz", vector)}


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b) -> tuple[Column, ...]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _met(points: DataFrame, rings: DataFrame, margin: float, f: float) -> DataFrame:
    """Points p with the edges b to e of rings whose cap (about the vertices' centre c), widened by margin, holds them.

    Caps meet points by whole degrees of latitude, so that the joins are on equal keys.
    """
    width = math.radians(1.0)
    ends = W.partitionBy(*RING).orderBy("seq")
    whole = W.partitionBy(*RING)
    vertices = rings.select(*RING, "seq", *[c.alias(n) for n, c in _named("b", _unit("lon", "lat", f)).items()])
    edges = vertices.withColumns({"e" + c: F.coalesce(F.lead("b" + c).over(ends), F.first("b" + c).over(ends.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))) for c in "xyz"})
    centred = vertices.withColumns({"s" + c: F.avg("b" + c).over(whole) for c in "xyz"})
    centred = centred.withColumn("len", F.sqrt(_dot(_at("s"), _at("s")))).withColumns({"c" + c: F.col("s" + c) / F.col("len") for c in "xyz"})
    caps = centred.groupBy(*RING, "cx", "cy", "cz").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min(_dot(_at("b"), _at("c")))))).alias("cap"))
    caps = caps.withColumn("cap", F.col("cap") + margin + 1e-9)
    middle = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cz"))))
    low, high = F.floor((middle - F.col("cap")) / width), F.floor((middle + F.col("cap")) / width)
    caps = caps.withColumn("band", F.explode(F.sequence(low, high)))
    placed = points.select("point_id", *[c.alias(n) for n, c in _named("p", _unit("lon", "lat", f)).items()])
    placed = placed.withColumn("band", F.floor(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pz")))) / width))
    near = placed.join(caps, "band").where(_dot(_at("p"), _at("c")) >= F.cos(F.least(F.col("cap"), F.lit(math.pi))))
    return near.join(edges, RING)


def contains(points: DataFrame, rings: DataFrame, buffer: float | None = None, f: float = FLATTENING) -> DataFrame:
    """Rows (point_id, basin_id): points inside an odd number of a basin's rings.

    A point is inside a ring if the arc to the point opposite to the ring's centre crosses its edges an odd number of times.
    A buffer (metres) adds points so near to an edge; a negative one removes them.
    """
    outside = tuple(-c for c in _at("c"))
    crossing = _met(points, rings, 0.0, f).withColumns(_named("q", _cross(_at("b"), _at("e"))) | _named("w", _cross(_at("p"), outside)))
    sides = [_dot(_at("p"), _at("q")), _dot(_at("c"), _at("q")), -_dot(_at("b"), _at("w")), _dot(_at("e"), _at("w"))]
    crosses = (F.least(*sides) > 0) | (F.greatest(*sides) < 0)
    counts = crossing.where(crosses).groupBy("point_id", "basin_id").agg(F.count("*").alias("n"))
    found = counts.where("n % 2 = 1").select("point_id", "basin_id")
    if buffer is None:
        return found
    near = near_edges(points, rings, abs(buffer), f)
    return found.unionByName(near).distinct() if buffer > 0 else found.join(near, ["point_id", "basin_id"], "left_anti")


def near_edges(points: DataFrame, rings: DataFrame, distance: float, f: float = FLATTENING) -> DataFrame:
    """Rows (point_id, basin_id): points within a distance (metres) of a vertex, or of the foot of their perpendicular on an edge."""
    angle = distance / A
    met = _met(points, rings, angle, f).withColumns(_named("q", _cross(_at("b"), _at("e")))).withColumn("len", F.sqrt(_dot(_at("q"), _at("q"))))
    vertex = _dot(_at("p"), _at("b")) >= math.cos(angle)
    p, q = _at("p"), _at("q")
    between = (_dot(_cross(q, _at("b")), p) >= 0) & (_dot(_cross(_at("e"), q), p) >= 0)
    edge = (F.col("len") > 0) & (F.abs(_dot(p, q)) <= math.sin(angle) * F.col("len")) & between
    return met.where(vertex | edge).select("point_id", "basin_id").distinct()


def masked(points: DataFrame, rings: DataFrame, buffer: float | None = None) -> DataFrame:
    """Adds the column inside: whether the point lies in any basin."""
    found = contains(points, rings, buffer).select("point_id").distinct().withColumn("inside", F.lit(True))
    return points.join(found, "point_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
