"""Synthesis of coefficient fields at points: a join on degree and order, and a sum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import GM, R, cartesian_to_spherical
from ..functions.harmonics import legendre, legendre_columns
from .adjustment import inverse
from .storage import stored


def _paired(field: DataFrame, max_degree: int, weight: Column | None) -> DataFrame:
    """One row (epoch, n, m) with cosine c and sine s, times weight."""
    factor = F.lit(1.0) if weight is None else weight
    c, s = (F.coalesce(F.sum(F.when(F.col("trig") == t, F.col("value"))), F.lit(0.0)) for t in (0, 1))
    paired = field.where(F.col("n") <= max_degree).groupBy("epoch", "n", "m").agg(c.alias("c"), s.alias("s"))
    return paired.withColumns({"c": F.col("c") * factor, "s": F.col("s") * factor})


def _parallels(points: DataFrame, max_degree: int, min_degree: int = 0) -> DataFrame:
    """Rows (lat, n, m, p) of the distinct latitudes of points."""
    lats = points.select("lat").distinct().withColumn("colat", F.lit(1.5707963267948966) - F.col("lat"))
    return legendre(lats, max_degree, "lat").withColumnRenamed("point_id", "lat").where(F.col("n") >= min_degree)


def _waves(points: DataFrame, max_degree: int, m: str = "m", trig: str = "trig", h: str = "h") -> DataFrame:
    """points, once for each order and cosine or sine, with the wave's value at the point's longitude."""
    orders = F.sequence(F.lit(0), F.lit(max_degree))
    both = F.transform(orders, lambda k: F.array(F.struct(k.alias("m"), F.lit(0).alias("t"), F.cos(k * F.col("lon")).alias("h")), F.struct(k.alias("m"), F.lit(1).alias("t"), F.sin(k * F.col("lon")).alias("h"))))
    waves = points.select("*", F.explode(F.flatten(both)).alias("_w")).where("_w.m > 0 or _w.t = 0")
    return waves.select(*points.columns, F.col("_w.m").alias(m), F.col("_w.t").alias(trig), F.col("_w.h").alias(h))


def synthesise_grid(field: DataFrame, points: DataFrame, max_degree: int, weight: Column | None = None, ratio: Column | float = 1.0, power: int = 1) -> DataFrame:
    """As synthesise, for points on common parallels: first sums over degrees on each parallel, then over orders at each point.

    A month and parallel is one row of 2 (max_degree + 1) sums, so no row of a point meets the square of the degree. Points
    of a parallel that differ in ratio count as different parallels; scattered points gain nothing.
    """
    placed = points.withColumn("ratio", (ratio if isinstance(ratio, Column) else F.lit(ratio)).cast("double")).select("point_id", "lon", "lat", "ratio")
    p = _parallels(points, max_degree).join(placed.select("lat", "ratio").distinct(), "lat").withColumn("p", F.col("p") * F.pow("ratio", (F.col("n") + power).cast("double")))
    sums = p.join(_paired(field, max_degree, weight), ["n", "m"]).groupBy("epoch", "lat", "ratio", "m").agg(F.sum(F.col("p") * F.col("c")).alias("a"), F.sum(F.col("p") * F.col("s")).alias("b"))
    rows = sums.groupBy("epoch", "lat", "ratio").agg(F.array_sort(F.collect_list(F.struct("m", "a", "b"))).alias("orders"))
    value = F.aggregate("orders", F.lit(0.0), lambda done, x: done + x["a"] * F.cos(x["m"] * F.col("lon")) + x["b"] * F.sin(x["m"] * F.col("lon")))
    return placed.join(rows, ["lat", "ratio"]).select("epoch", "point_id", value.alias("value"))


def synthesise(field: DataFrame, points: DataFrame, max_degree: int, weight: Column | None = None, ratio: Column | float = 1.0, power: int = 1) -> DataFrame:
    """Rows (epoch, point_id, value) of the potential on the unit sphere; weight: a further factor by n, like an inverse kernel.

    ratio, a column of points, is the reference radius over the point's; it counts to the power n + power.

    Coefficients are first paired to one row (epoch, n, m) with cosine and sine, which halves the join.
    """
    paired = _paired(field, max_degree, weight)
    basis = legendre(points.withColumn("colat", F.lit(1.5707963267948966) - F.col("lat")), max_degree).join(points.select("point_id", "lon", (ratio if isinstance(ratio, Column) else F.lit(ratio)).alias("ratio")), "point_id")
    basis = basis.withColumn("p", F.col("p") * F.pow("ratio", (F.col("n") + power).cast("double")))
    basis = basis.select("point_id", "n", "m", (F.col("p") * F.cos(F.col("m") * F.col("lon"))).alias("pc"), (F.col("p") * F.sin(F.col("m") * F.col("lon"))).alias("ps"))
    return basis.join(paired, ["n", "m"]).groupBy("epoch", "point_id").agg(F.sum(F.col("pc") * F.col("c") + F.col("ps") * F.col("s")).alias("value"))


def gridded_rms(values: DataFrame) -> DataFrame:
    """Root mean square over epochs at each point."""
    return values.groupBy("point_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def basis_matrix(points: DataFrame, max_degree: int) -> DataFrame:
    """Rows (point_id, n, m, trig, v): the harmonics at the points, columns of the synthesis matrix."""
    p = legendre(points.withColumn("colat", F.lit(1.5707963267948966) - F.col("lat")), max_degree).join(points.select("point_id", "lon"), "point_id")
    both = F.array(F.struct(F.lit(0).alias("trig"), (F.col("p") * F.cos(F.col("m") * F.col("lon"))).alias("v")), F.struct(F.lit(1).alias("trig"), (F.col("p") * F.sin(F.col("m") * F.col("lon"))).alias("v")))
    return p.select("point_id", "n", "m", F.explode(both).alias("x")).select("point_id", "n", "m", "x.trig", "x.v").where("not (m = 0 and trig = 1)")


def analyse(values: DataFrame, points: DataFrame, max_degree: int, min_degree: int = 0) -> DataFrame:
    """Coefficients (epoch, n, m, trig, value) of gridded values, by area-weighted least squares order by order.

    Values (epoch, point_id, value) lie on a regular grid (point_id, lon, lat, area), where orders do not mix. Waves are
    summed along parallels first, so only parallels meet degrees; each order's small system is solved in a group of its own.
    """
    p = _parallels(points, max_degree, min_degree)
    placed = values.join(points.select("point_id", "lon", "lat", "area"), "point_id").where("value is not null")
    waves = _waves(placed, max_degree).groupBy("epoch", "lat", "m", "trig").agg(F.sum(F.col("h") * F.col("area") * F.col("value")).alias("_s"))
    right = waves.join(p, ["lat", "m"]).groupBy("epoch", "m", "trig", F.col("n").alias("j")).agg(F.sum(F.col("p") * F.col("_s")).alias("rhs"))
    solved = inverse(_order_normals(points, p, max_degree), ["m", "trig"])
    return solved.join(right, ["m", "trig", "j"]).groupBy("epoch", F.col("i").cast("int").alias("n"), "m", "trig").agg(F.sum(F.col("v") * F.col("rhs")).alias("value"))


def _order_normals(points: DataFrame, p: DataFrame, max_degree: int) -> DataFrame:
    """Area-weighted normal matrices (m, trig, i, j, v) of the orders, from a wave's square sum on each parallel."""
    squares = _waves(points.select("lon", "lat", "area"), max_degree).groupBy("lat", "m", "trig").agg(F.sum(F.col("h") * F.col("h") * F.col("area")).alias("_s"))
    left = squares.join(p.select("lat", "m", F.col("n").alias("i"), F.col("p").alias("u")), ["lat", "m"])
    pairs = left.join(p.select("lat", "m", F.col("n").alias("j"), "p"), ["lat", "m"])
    return pairs.groupBy("m", "trig", "i", "j").agg(F.sum(F.col("u") * F.col("_s") * F.col("p")).alias("v"))


def propagate(covariance: DataFrame, points: DataFrame, max_degree: int) -> DataFrame:
    """Standard deviations (point_id, sigma) of synthesised values; covariance rows (n, m, trig, n2, m2, trig2, v)."""
    a = basis_matrix(points, max_degree)
    other = a.select("point_id", F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("trig").alias("trig2"), F.col("v").alias("w"))
    half = a.withColumnRenamed("v", "u").join(covariance, ["n", "m", "trig"]).groupBy("point_id", "n2", "m2", "trig2").agg(F.sum(F.col("u") * F.col("v")).alias("cu"))
    return half.join(other, ["point_id", "n2", "m2", "trig2"]).groupBy("point_id").agg(F.sqrt(F.sum(F.col("cu") * F.col("w"))).alias("sigma"))


def propagate_grid(covariance: DataFrame, points: DataFrame, max_degree: int) -> DataFrame:
    """As propagate, for points on common parallels: along one, the variance is a Fourier series of pairs of orders.

    Degrees meet parallels, never points: a parallel is one row of (2 max_degree + 1)^2 sums, in which its points evaluate their waves.
    """
    p = _parallels(points, max_degree)
    half = p.join(covariance, ["n", "m"]).groupBy("lat", "m", "trig", "n2", "m2", "trig2").agg(F.sum(F.col("p") * F.col("v")).alias("half"))
    other = p.select("lat", F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("p").alias("q"))
    sums = half.join(other, ["lat", "n2", "m2"]).groupBy("lat", "m", "trig", "m2", "trig2").agg(F.sum(F.col("half") * F.col("q")).alias("v"))
    rows = sums.groupBy("lat").agg(F.collect_list(F.struct("m", "trig", "m2", "trig2", "v")).alias("pairs"))
    wave = lambda m, t: F.when(t == 0, F.cos(m * F.col("lon"))).otherwise(F.sin(m * F.col("lon")))
    variance = F.aggregate("pairs", F.lit(0.0), lambda done, x: done + x["v"] * wave(x["m"], x["trig"]) * wave(x["m2"], x["trig2"]))
    return points.select("point_id", "lon", "lat").join(rows, "lat").select("point_id", F.sqrt(F.greatest(F.lit(0.0), variance)).alias("sigma"))


def gradient_fields(field: DataFrame) -> dict[str, DataFrame]:
    """Fields whose synthesis, to the power n + 1 of the radius ratio and times GM / R^2, is the gradient along x, y and z.

    A derivative of a solid harmonic of degree n is a sum of those of degree n + 1 and the neighbouring orders, so the
    gradient of a field is a projection of its rows.
    """
    n, m, v = F.col("n"), F.col("m"), F.col("value")
    cosine = F.col("trig") == 0
    base = (2 * n + 1) / (2 * n + 3)
    up = F.sqrt(base * (n + m + 1) * (n + m + 2)) * F.when(m == 0, F.sqrt(F.lit(2.0))).otherwise(1.0) / 2
    down = F.sqrt(base * (n - m + 1) * (n - m + 2) * F.when(m == 1, 2.0).otherwise(1.0)) / 2
    straight = F.sqrt(base * (n + m + 1) * (n - m + 1))
    same, swapped = F.col("trig"), 1 - F.col("trig")
    sign = F.when(cosine, -1.0).otherwise(1.0)
    terms = {
        "x": [(m + 1, same, -up * v), (m - 1, same, down * v)],
        "y": [(m + 1, swapped, sign * up * v), (m - 1, swapped, sign * down * v)],
        "z": [(m, same, -straight * v)],
    }
    fields = {}
    for axis, parts in terms.items():
        rows = field.select("epoch", (n + 1).alias("n"), F.explode(F.array(*[F.struct(o.alias("m"), t.alias("trig"), x.alias("value")) for o, t, x in parts])).alias("x"))
        rows = rows.select("epoch", "n", "x.*").where("m >= 0 and not (m = 0 and trig = 1)")
        fields[axis] = rows.groupBy("epoch", "n", "m", "trig").agg(F.sum("value").alias("value"))
    return fields


def acceleration(field: DataFrame, points: DataFrame, max_degree: int, gm: float = GM, r: float = R) -> DataFrame:
    """Rows (epoch, point_id, gx, gy, gz) at points (point_id, x, y, z) outside the sphere."""
    distance, colat, lon = cartesian_to_spherical("x", "y", "z")
    placed = points.select("point_id", lon.alias("lon"), (F.lit(1.5707963267948966) - colat).alias("lat"), (r / distance).alias("near"))
    joined = None
    for axis, part in gradient_fields(field.where(F.col("n") <= max_degree)).items():
        g = synthesise(part, placed, max_degree + 1, ratio=F.col("near")).withColumnRenamed("value", f"g{axis}")
        g = g.withColumn(f"g{axis}", F.col(f"g{axis}") * (gm / r**2))
        joined = g if joined is None else joined.join(g, ["epoch", "point_id"], "full")
    return joined.na.fill(0.0, ["gx", "gy", "gz"])


def window_matrix(points: DataFrame, max_degree: int, min_degree: int = 0) -> DataFrame:
    """Rows (i_n, i_m, i_trig, n, m, trig, v): synthesis, multiplication by the points' values, and analysis in one matrix.

    points: a regular grid (point_id, lon, lat, area, value). Products of waves are summed along parallels before these meet
    degrees; the orders' small inverses come last.
    """
    p = _parallels(points, max_degree, min_degree)
    waves = _waves(_waves(points.select("lon", "lat", "area", "value"), max_degree, "i_m", "i_trig", "g"), max_degree)
    sums = waves.groupBy("lat", "i_m", "i_trig", "m", "trig").agg(F.sum(F.col("g") * F.col("h") * F.col("area") * F.col("value")).alias("_s"))
    left = sums.join(p.select("lat", F.col("m").alias("i_m"), F.col("n").alias("j"), F.col("p").alias("u")), ["lat", "i_m"])
    product = left.join(p, ["lat", "m"]).groupBy("j", "i_m", "i_trig", "n", "m", "trig").agg(F.sum(F.col("u") * F.col("_s") * F.col("p")).alias("_p"))
    solved = inverse(_order_normals(points, p, max_degree), ["m", "trig"]).withColumnsRenamed({"m": "i_m", "trig": "i_trig"})
    return solved.join(product, ["i_m", "i_trig", "j"]).groupBy(F.col("i").cast("int").alias("i_n"), "i_m", "i_trig", "n", "m", "trig").agg(F.sum(F.col("v") * F.col("_p")).alias("v"))


def analyse_scattered(values: DataFrame, points: DataFrame, max_degree: int, min_degree: int = 0, tolerance: float = 1e-13, most: int = 500) -> DataFrame:
    """Coefficients (epoch, n, m, trig, value) of values at any points (point_id, lon, lat, area), by area-weighted least squares.

    Conjugate gradients without a matrix: an iteration is one pass over the points, in which every batch synthesises the search
    directions of all epochs at its points and sums them back, weighed by area. The iterates, coefficients times
    epochs, are what the driver holds; a task adds as many sums, and no row is made for a point and a coefficient.
    A point without a value in an epoch counts as 0 there. Stops where the residual has fallen by tolerance, or fails.
    """
    keys = [(n, m, t) for n in range(min_degree, max_degree + 1) for m in range(n + 1) for t in (0, 1) if m or not t]
    epochs = [r["epoch"] for r in values.select("epoch").distinct().sort("epoch").collect()]  # a date a field
    spark, kind = values.sparkSession, values.schema["epoch"].dataType.simpleString()
    at = spark.createDataFrame(list(enumerate(epochs)), f"e int, epoch {kind}")
    packed = values.where("value is not null").join(at, "epoch").groupBy("point_id").agg(F.map_from_entries(F.collect_list(F.struct("e", F.col("value").cast("double")))).alias("found"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(len(epochs) - 1, 0))), lambda e: F.coalesce(F.col("found")[e], F.lit(0.0)))
    rows = stored(points.select("point_id", *[F.col(c).cast("double") for c in ("lon", "lat", "area")]).join(packed, "point_id").select("lon", "lat", "area", filled.alias("held")))
    shape = (len(keys), len(epochs))

    def summed(direction: np.ndarray | None) -> np.ndarray:
        """A' W A times the direction, or A' W times the values."""

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                lon, lat, area = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat", "area"))
                p = legendre_columns(max_degree, np.pi / 2 - lat)
                a = np.stack([p[n, m] * (np.sin(m * lon) if t else np.cos(m * lon)) for n, m, t in keys])
                held = batch.column("held").flatten().to_numpy(zero_copy_only=False).reshape(len(lon), -1) if direction is None else a.T @ direction
                total += a @ (area[:, None] * held)
            k, e = np.indices(shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(e), pa.array(total.ravel())], names=["k", "e", "v"])

        out = np.zeros(shape)
        for r in rows.mapInArrow(run, "k long, e long, v double").groupBy("k", "e").agg(F.sum("v").alias("v")).toLocalIterator():
            out[r["k"], r["e"]] = r["v"]
        return out

    x, residual = np.zeros(shape), summed(None) if epochs else np.zeros(shape)
    direction, size = residual, (residual**2).sum(axis=0)
    goal, turn = tolerance**2 * size, 0
    while (size > goal).any():
        if turn == most:
            raise ValueError("the points don't determine the coefficients")
        product = summed(direction)
        curvature = (direction * product).sum(axis=0)
        step = np.divide(size, curvature, out=np.zeros_like(size), where=(curvature > 0) & (size > goal))
        x, residual = x + step * direction, residual - step * product
        before, size = size, (residual**2).sum(axis=0)
        direction, turn = residual + np.divide(size, before, out=np.zeros_like(size), where=before > 0) * direction, turn + 1
    found = [(epochs[e], *key, float(x[k, e])) for k, key in enumerate(keys) for e in range(len(epochs))]
    return spark.createDataFrame(found, f"epoch {kind}, n int, m int, trig int, value double")
