"""Fully normalised Legendre functions at points, long form."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def legendre_columns(max_degree: int, colat: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """P_nm of every order m and degree n up to max_degree, by the recursion in n from the sectorial terms."""
    t, u = np.cos(colat), np.sin(colat)
    p = {(0, 0): np.ones_like(t)}
    for m in range(max_degree + 1):
        if m:
            p[m, m] = p[m - 1, m - 1] * u * np.sqrt(3.0 if m == 1 else (2 * m + 1) / (2 * m))
        for n in range(m + 1, max_degree + 1):
            scale = np.sqrt((2 * n + 1) / ((n - m) * (n + m)))
            p[n, m] = scale * np.sqrt(2 * n - 1) * t * p[n - 1, m]
            if n > m + 1:
                p[n, m] -= scale * np.sqrt((n - m - 1) * (n + m - 1) / (2 * n - 3)) * p[n - 2, m]
    return p


def legendre(points: DataFrame, max_degree: int, point_id: str = "point_id", colat: str = "colat") -> DataFrame:
    """Rows (point_id, n, m, p) for each point; a batch of points is one vector of each recursion step."""

    def run(batches):
        keys = [(n, m) for m in range(max_degree + 1) for n in range(m, max_degree + 1)]
        step = max(1, 200_000 // len(keys))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                p = legendre_columns(max_degree, part.column(1).to_numpy(zero_copy_only=False))
                rows = part.num_rows
                ids = pa.concat_arrays([part.column(0)] * len(keys))
                n, m = (np.repeat(np.array([k[j] for k in keys], np.int32), rows) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(m), pa.array(np.concatenate([p[k] for k in keys]))], names=["point_id", "n", "m", "p"])

    read = points.select(F.col(point_id).alias("point_id"), F.col(colat).cast("double").alias("colat"))
    return read.mapInArrow(run, read.select("point_id").schema.add("n", "integer").add("m", "integer").add("p", "double"))


def legendre_polynomials(t: Column, max_degree: int) -> Column:
    """Array over degrees 0 to max_degree of the normalised polynomials and their first two derivatives: structs (n, p, d1, d2)."""
    zero = F.lit(0.0)
    start = F.array(F.struct(F.lit(0).alias("n"), F.lit(1.0).alias("p"), zero.alias("d1"), zero.alias("d2")))

    def step(done, n):
        one, two = F.get(done, n - 1), F.get(done, n - 2)
        before = {c: F.coalesce(two[c], zero) for c in ("p", "d1", "d2")}
        p = ((2 * n - 1) * t * one["p"] - (n - 1) * before["p"]) / n
        return F.array_append(done, F.struct(n.alias("n"), p.alias("p"), ((2 * n - 1) * one["p"] + before["d1"]).alias("d1"), ((2 * n - 1) * one["d1"] + before["d2"]).alias("d2")))

    plain = F.aggregate(F.sequence(F.lit(1), F.lit(max_degree)), start, step) if max_degree else start
    return F.transform(plain, lambda x: F.struct(x["n"].alias("n"), *[(x[c] * F.sqrt(2 * x["n"] + 1)).alias(c) for c in ("p", "d1", "d2")]))


def legendre_sum(coefficients: Column, t: Column, derivative: int = 0) -> Column:
    """Sum of an array's entries times the normalised polynomials of degrees 0, 1, ..., by the backward recursion.

    derivative 1 or 2: of the sum by t, by the same recursion differentiated.
    """
    if derivative not in (0, 1, 2):
        raise ValueError("the derivative is 0, 1 or 2")
    pairs = F.reverse(F.transform(coefficients, lambda c, n: F.struct(n.cast("double").alias("n"), (c * F.sqrt(2 * n + 1)).alias("c"))))
    orders = range(derivative + 1)
    zero = F.struct(*[F.lit(0.0).alias(f"{b}{k}") for k in orders for b in ("one", "two")])

    def step(b, x):
        n = x["n"]
        up, down = (2 * n + 1) / (n + 1), (n + 1) / (n + 2)
        new = [up * (t * b[f"one{k}"] + (k * b[f"one{k - 1}"] if k else 0.0)) - down * b[f"two{k}"] for k in orders]
        return F.struct(*[v for k in orders for v in ((new[k] + (x["c"] if k == 0 else 0.0)).alias(f"one{k}"), b[f"one{k}"].alias(f"two{k}"))])

    return F.aggregate(pairs, zero, step, lambda b: b[f"one{derivative}"])


def matern_variances(sigma: float, alpha: float, nu: float, max_degree: int, min_degree: int = 2) -> list[float]:
    """Degree factors of the Legendre-Matern covariance for legendre_sum; 0 below min_degree."""
    return [0.0 if n < min_degree else sigma**2 * (alpha**2 + n * n) ** (-nu - 0.5) * (2 * n + 1) for n in range(max_degree + 1)]


def kernel_values(psi: Column, coefficients: list[float]) -> Column:
    """An isotropic kernel at spherical distance psi from its factors by degree."""
    return legendre_sum(F.array(*[F.lit(float(k)) for k in weighted(coefficients)]), F.cos(psi))


def weighted(coefficients: list[float]) -> list[float]:
    return [k * math.sqrt(2 * n + 1) for n, k in enumerate(coefficients)]


def modulation_transfer(spark, coefficients: list[float], max_psi: float = math.pi, steps: int = 100) -> DataFrame:
    """Rows (k, psi, mtf) at equal distances: how far the middle of two pulses that distance apart lies below their peak.

    The peak of the two is sought over the samples; the kernel is even.
    """
    psi = F.col("k") * (max_psi / (steps - 1))
    samples = spark.range(steps).select(F.col("id").cast("int").alias("k")).select("k", psi.alias("psi"), kernel_values(psi, coefficients).alias("v"), (2 * kernel_values(psi / 2, coefficients)).alias("middle"))
    at = samples.select(F.col("k").alias("j"), F.col("v").alias("first"))
    shifted = samples.select(F.col("k").alias("gap"), F.col("v").alias("second"))
    pairs = samples.select("k", "psi", "middle").join(at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))), "k")
    peaks = pairs.withColumn("gap", F.abs(F.col("k") - F.col("j"))).join(shifted, "gap")
    peaks = peaks.groupBy("k").agg(F.first("psi").alias("psi"), F.first("middle").alias("middle"), F.max(F.col("first") + F.col("second")).alias("peak"))
    return peaks.select("k", "psi", F.greatest(F.lit(0.0), 1 - F.col("middle") / F.col("peak")).alias("mtf"))


def spatial_resolution(spark, coefficients: list[float], r: float = 6378136.3, steps: int = 20_000) -> DataFrame:
    """One row (resolution): the least distance in metres of two pulses with a dip between them.

    By symmetry the dip opens in the middle, where the kernel's curvature turns positive: twice the distance of
    its first inflection, found between two samples by a straight line. No inflection, no row.
    """
    psi = F.col("id") * (math.pi / 2 / steps)
    p = legendre_polynomials(F.cos(psi), len(coefficients) - 1)
    bent = F.zip_with(p, F.array(*[F.lit(float(k)) for k in weighted(coefficients)]), lambda x, k: k * (F.sin(psi) ** 2 * x["d2"] - F.cos(psi) * x["d1"]))
    samples = spark.range(steps + 1).select("id", psi.alias("psi"), F.aggregate(bent, F.lit(0.0), lambda a, x: a + x).alias("bend"))
    later = samples.select((F.col("id") - 1).alias("id"), F.col("psi").alias("psi1"), F.col("bend").alias("bend1"))
    turns = samples.join(later, "id").where("bend < 0 and bend1 >= 0")
    zero = F.col("psi") - F.col("bend") * (F.col("psi1") - F.col("psi")) / (F.col("bend1") - F.col("bend"))
    return turns.agg(F.min(2 * r * zero).alias("resolution")).where("resolution is not null")


def legendre_of_order(points: DataFrame, max_degree: int, order: int, colat: str = "colat") -> DataFrame:
    """Rows (point_id, n, m, p) of one order; an order above max_degree has none and is refused."""
    if order > max_degree:
        raise ValueError("the order exceeds the degree")
    return legendre(points, max_degree, colat=colat).where(F.col("m") == order)
