"""Ocean transport across a section: bottom pressure times the depth's slope, integrated along the path by trapezoids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.geodesy import A, GM, GRS80, R, colatitude, geocentric_radius
from .synthesis import basis_matrix

#: Fixed value: rotation of the Earth in radians a second.
ROTATION = 7.29211585531e-5


def loxodrome(spark: SparkSession, lon: float, lat: float, azimuth: float, sampling: float, a: float = A) -> DataFrame:
    """Points (k, path, lon, lat) of the line of constant azimuth through a point, sampled in metres, half round the globe each way."""
    parallel = abs(math.cos(azimuth)) < 1e-15
    reach = math.pi * a * (math.cos(lat) if parallel else 1.0)
    last = math.ceil(reach / sampling) - 1
    path = F.col("k") * float(sampling)
    points = spark.range(-last, last + 1).select(F.col("id").alias("k")).select("k", path.alias("path"))
    if parallel:
        turn = F.pmod(F.col("path") / (a * math.cos(lat)) + lon + math.pi, F.lit(2 * math.pi)) - math.pi
        return points.select("*", turn.alias("lon"), F.lit(lat).alias("lat"))
    raw = F.col("path") / a * math.cos(azimuth) + lat
    folded = F.when(raw > math.pi / 2, math.pi - raw).when(raw < -math.pi / 2, -raw - math.pi).otherwise(raw)
    points = points.withColumn("lat", folded)
    north = F.log(F.tan(F.col("lat") / 2 + math.pi / 4)) - math.log(math.tan(lat / 2 + math.pi / 4))
    return points.select("k", "path", (lon + math.tan(azimuth) * north).alias("lon"), "lat")


def bilinear(points: DataFrame, grid: DataFrame, west: float, south: float, dlon: float, dlat: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds value at the points inside a regular grid (i_lon, i_lat, value) counted from its south-west node, keys like epoch.

    Each point looks up the corners of its cell by equal keys; those outside the grid get no row.
    """
    x, y = (F.col("lon") - west) / dlon, (F.col("lat") - south) / dlat
    placed = points.withColumns({"_x": x, "_y": y}).where("_x >= 0 and _y >= 0")
    corners = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)])
    spread = placed.withColumn("_c", F.explode(corners)).withColumns({"i_lon": (F.floor("_x") + F.col("_c.dx")).cast("int"), "i_lat": (F.floor("_y") + F.col("_c.dy")).cast("int")})
    weight = (1 - F.abs(F.col("_x") - F.col("i_lon"))) * (1 - F.abs(F.col("_y") - F.col("i_lat")))
    met = spread.withColumn("_w", weight).where("_w > 0").join(grid.select(*keys, "i_lon", "i_lat", "value"), ["i_lon", "i_lat"])
    found = met.groupBy(*keys, *points.columns).agg(F.sum("_w").alias("_all"), F.sum(F.col("_w") * F.col("value")).alias("value"))
    return found.where("_all > 0.999999999").drop("_all")


def slopes(section: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds dz, the derivative of z along the path: second order inside for uneven steps too, one-sided at the ends."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("path")  # a section is a line of points
    x, z = F.col("path"), F.col("z")
    before, after = x - F.lag("path").over(w), F.lead("path").over(w) - x
    left, right = (z - F.lag("z").over(w)) / before, (F.lead("z").over(w) - z) / after
    inner = (left * after + right * before) / (before + after)
    return section.withColumn("dz", F.coalesce(inner, right, left))


def mean_coriolis(section: DataFrame, rotation: float = ROTATION) -> DataFrame:
    """One row: the Coriolis parameter at the median latitude, and whether the section is a parallel or a meridian."""
    middle = section.agg(F.median("lat").alias("_lat"), F.median("lon").alias("_lon"))
    near = lambda c, m: F.abs(F.col(c) - F.col(m)) <= 1e-8 + 1e-5 * F.abs(m)
    return section.crossJoin(F.broadcast(middle)).groupBy((2 * rotation * F.sin("_lat")).alias("coriolis")).agg(F.bool_and(near("lat", "_lat")).alias("parallel"), F.bool_and(near("lon", "_lon")).alias("meridian"))


def _layered(rows: DataFrame, bounds: list[float], by: list[str]) -> DataFrame:
    """Trapezoid sums (by, layer, integral) of f dz over the path, dz being 0 outside the layer's depths."""
    layers = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))])
    inside = F.when((F.col("z") >= F.col("_l.low")) & (F.col("z") <= F.col("_l.high")), F.col("f") * F.col("dz")).otherwise(0.0)
    spread = rows.withColumn("_l", F.explode(layers)).select(*by, F.col("_l.layer").alias("layer"), "path", inside.alias("y"))
    w = W.partitionBy(*by, "layer").orderBy("path")
    strip = (F.col("y") + F.lead("y").over(w)) / 2 * (F.lead("path").over(w) - F.col("path"))
    return spread.withColumn("_s", strip).groupBy(*by, "layer").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("integral"))


def spatial(section: DataFrame, pressure: DataFrame, bounds: list[float], density: float = 1025.0, rotation: float = ROTATION) -> DataFrame:
    """Transport (epoch, layer, transport) from bottom pressure (epoch, path, value) on a section (path, lon, lat, z, dz)."""
    rows = section.join(pressure.withColumnRenamed("value", "f"), "path")
    sums = _layered(rows, bounds, ["epoch"]).crossJoin(F.broadcast(mean_coriolis(section, rotation)))  # one row
    return sums.select("epoch", "layer", (F.col("integral") / (density * F.col("coriolis"))).alias("transport"))


def spectral_factors(section: DataFrame, love: DataFrame, bounds: list[float], max_degree: int, density: float = 1025.0, rotation: float = ROTATION, gm: float = GM, r: float = R) -> DataFrame:
    """Rows (layer, n, m, trig, factor): what a coefficient adds to the transport. On a parallel, order 0 adds nothing."""
    radius, theta = geocentric_radius("lat"), colatitude("lat")
    placed = section.select(F.col("path").alias("point_id"), "lon", (math.pi / 2 - theta).alias("lat"))
    scale = section.select("path", "z", "dz", radius.alias("_r"), GRS80.normal_gravity(radius, theta).alias("_g"))
    basis = basis_matrix(placed, max_degree).withColumnRenamed("point_id", "path").join(scale, "path").join(F.broadcast(love.select("n", "k")), "n")
    pressure = kernels.inverse(kernels.kernel("obp")(F.col("n"), F.col("_r"), F.col("_g"), F.col("k"))) * F.pow(r / F.col("_r"), F.col("n") + 1.0) * (gm / r)
    sums = _layered(basis.withColumn("f", F.col("v") * pressure), bounds, ["n", "m", "trig"]).crossJoin(F.broadcast(mean_coriolis(section, rotation)))
    factor = F.when(F.col("parallel") & (F.col("m") == 0), 0.0).otherwise(F.col("integral") / (density * F.col("coriolis")))
    return sums.select("layer", "n", "m", "trig", factor.alias("factor"))


def spectral(field: DataFrame, factors: DataFrame) -> DataFrame:
    """Transport (epoch, layer, transport) of coefficient fields."""
    return field.join(factors, ["n", "m", "trig"]).groupBy("epoch", "layer").agg(F.sum(F.col("value") * F.col("factor")).alias("transport"))
