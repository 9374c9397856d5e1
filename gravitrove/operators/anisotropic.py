"""Kernels given by a full matrix of harmonics: rows (n, m, trig, n2, m2, trig2, v).

The kernel about a source is a field, whose coefficients are the source's harmonics times the matrix; what holds for fields holds for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored
from .synthesis import basis_matrix, synthesise, synthesise_grid

KEY, OTHER = ["n", "m", "trig"], ["n2", "m2", "trig2"]


def isotropic_matrix(spark: SparkSession, coefficients: list[float]) -> DataFrame:
    """The matrix of an isotropic kernel with factors by degree."""
    rows = [(n, m, t, n, m, t, float(k)) for n, k in enumerate(coefficients) for m in range(n + 1) for t in (0, 1) if m or not t]
    return spark.createDataFrame(rows, "n int, m int, trig int, n2 int, m2 int, trig2 int, v double")


def source_fields(matrix: DataFrame, sources: DataFrame, max_degree: int) -> DataFrame:
    """Fields (epoch, n, m, trig, value) of the kernel about each source (point_id, lon, lat); epoch is the source's id."""
    y = basis_matrix(sources, max_degree).withColumnRenamed("v", "y")
    return y.join(matrix, KEY).groupBy(F.col("point_id").alias("epoch"), *[F.col(o).alias(k) for k, o in zip(KEY, OTHER)]).agg(F.sum(F.col("y") * F.col("v")).alias("value"))


def kernel_values(matrix: DataFrame, sources: DataFrame, points: DataFrame, max_degree: int, on_parallels: bool = False) -> DataFrame:
    """Rows (source_id, point_id, value) for every source and point; on_parallels: points share parallels, where sums over degrees come first."""
    made = (synthesise_grid if on_parallels else synthesise)(source_fields(matrix, sources, max_degree), points, max_degree)
    return made.select(F.col("epoch").alias("source_id"), "point_id", "value")


def _at_own(fields: DataFrame, points: DataFrame, max_degree: int) -> DataFrame:
    """Rows (epoch, point_id, value): fields (epoch, ...) each at its own points (epoch, point_id, lon, lat) alone."""
    y = basis_matrix(points, max_degree).withColumnRenamed("v", "y").join(points.select("epoch", "point_id"), "point_id")
    return y.join(fields, ["epoch", *KEY]).groupBy("epoch", "point_id").agg(F.sum(F.col("y") * F.col("value")).alias("value"))


def _along(psi: Column, lon: float, lat: float, azimuth: float) -> tuple[Column, Column]:
    """Longitude and latitude at distance psi from a point, in direction azimuth, clockwise from north."""
    z = math.sin(lat) * F.cos(psi) + math.cos(lat) * math.cos(azimuth) * F.sin(psi)
    turn = F.atan2(math.sin(azimuth) * F.sin(psi) * math.cos(lat), F.cos(psi) - math.sin(lat) * z)
    return lon + turn, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))


def modulation_transfer(spark: SparkSession, matrix: DataFrame, max_degree: int, lon: float = 0.0, lat: float = 0.0, azimuth: float = 0.0, max_psi: float = math.pi, steps: int = 100) -> DataFrame:
    """Rows (k, psi, mtf): how far the middle of two pulses lies below their peak, one pulse at a point, the other psi along a great circle.

    The peak is sought over the samples between the pulses, two a step, so that the middle is one of them.
    """
    step = max_psi / (steps - 1)
    place = lambda psi: [c.alias(n) for n, c in zip(("lon", "lat"), _along(psi, lon, lat, azimuth))]
    sources = spark.range(steps).select(F.col("id").alias("point_id"), *place(F.col("id") * step))
    points = spark.range(2 * steps - 1).select(F.col("id").alias("point_id"), *place(F.col("id") * (step / 2)))
    values = stored(kernel_values(matrix, sources, points, max_degree))
    first = values.where("source_id = 0").select("point_id", F.col("value").alias("first"))
    both = values.where("point_id <= 2 * source_id").join(first, "point_id").withColumn("sum", F.col("value") + F.col("first"))
    found = both.groupBy(F.col("source_id").cast("int").alias("k")).agg(F.max("sum").alias("peak"), F.max(F.when(F.col("point_id") == F.col("source_id"), F.col("sum"))).alias("middle"))
    return found.select("k", (F.col("k") * step).alias("psi"), F.greatest(F.lit(0.0), 1 - F.col("middle") / F.col("peak")).alias("mtf"))


def spatial_resolution(spark: SparkSession, matrix: DataFrame, max_degree: int, lon: float = 0.0, lat: float = 0.0, direction: str = "north_south", r: float = 6378136.3, threshold: float = 1000.0, parts: int = 32, between: int = 33) -> float | None:
    """The least distance in metres, to within threshold, of two pulses about a point with a dip between them; None without any.

    The pulses lie on the point's meridian, or on its parallel. Each round evaluates `parts` distances at `between` places on the
    way, and the first with a dip, together with the one before it, bounds the next round.
    """
    if direction not in ("north_south", "east_west"):
        raise ValueError(f"no direction {direction}: north_south or east_west")
    scale = r if direction == "north_south" else r * math.cos(lat)
    low, high = 0.0, math.pi
    while (high - low) * scale > threshold:
        width = (high - low) / parts
        psi = low + (F.col("id") + 1) * width
        ways = spark.range(parts).select(F.col("id").alias("epoch"), psi.alias("psi"), F.explode(F.sequence(F.lit(0), F.lit(between - 1))).alias("at"))
        offset = F.col("psi") * (F.col("at") / (between - 1) - 0.5)
        here = (F.lit(lon), lat + offset) if direction == "north_south" else (lon + offset, F.lit(lat))
        points = stored(ways.select((F.col("epoch") * between + F.col("at")).alias("point_id"), "epoch", "at", here[0].alias("lon"), here[1].alias("lat")))
        ends = points.where(F.col("at").isin(0, between - 1))
        fields = source_fields(matrix, ends, max_degree).join(ends.select(F.col("point_id").alias("epoch"), F.col("epoch").alias("pair")), "epoch")
        pairs = fields.groupBy(F.col("pair").alias("epoch"), *KEY).agg(F.sum("value").alias("value"))
        values = _at_own(pairs, points, max_degree).join(points.select("point_id", "at"), "point_id")
        line = values.groupBy("epoch").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("v"))
        dip = F.exists(F.sequence(F.lit(1), F.lit(between - 2)), lambda k: (F.col("v")[k] < F.col("v")[k - 1]) & (F.col("v")[k] <= F.col("v")[k + 1]))
        first = line.where(dip).agg(F.min("epoch")).first()[0]
        if first is None:
            return None
        low, high = low + first * width, low + (first + 1) * width
    return (low + high) / 2 * scale


def to_coefficients(values: DataFrame, nodes: DataFrame, matrix: DataFrame, max_degree: int) -> DataFrame:
    """Rows (epoch, n, m, trig, value) of anisotropic basis functions: values (epoch, point_id, value) at nodes (point_id, lon, lat).

    The nodes are summed into harmonics first, so the matrix meets as many columns as there are epochs, however many nodes.
    """
    y = basis_matrix(nodes, max_degree).withColumnRenamed("v", "y")
    sums = values.join(y, "point_id").groupBy("epoch", *[F.col(k).alias(o) for k, o in zip(KEY, OTHER)]).agg(F.sum(F.col("value") * F.col("y")).alias("c"))
    return sums.join(matrix, OTHER).groupBy("epoch", *KEY).agg(F.sum(F.col("c") * F.col("v")).alias("value"))


def to_grid(values: DataFrame, nodes: DataFrame, matrix: DataFrame, points: DataFrame, max_degree: int, weight: Column | None = None) -> DataFrame:
    """Rows (epoch, point_id, value) of the basis functions at points on common parallels."""
    return synthesise_grid(to_coefficients(values, nodes, matrix, max_degree), points, max_degree, weight)
