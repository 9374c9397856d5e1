"""Normal equations: rows (sys_id, i, j, v) with both triangles, (sys_id, i, rhs) and (sys_id, lpl, obs).

Products, sums and traces are joins. Of many small systems, each is factored in one group of applyInPandas: systems run side
by side, and one must fit a task. One large system goes by blocks instead (blocks.py).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import solve_positive

ENTRY = "i long, j long, v double"


def _dense(rows: pd.DataFrame, index: np.ndarray) -> np.ndarray:
    matrix = np.zeros((len(index), len(index)))
    np.add.at(matrix, (np.searchsorted(index, rows["i"]), np.searchsorted(index, rows["j"])), rows["v"])
    return matrix


def _sparse(matrix: np.ndarray, index: np.ndarray, keys: dict) -> pd.DataFrame:
    i, j = np.nonzero(matrix)
    return pd.DataFrame({**keys, "i": index[i], "j": index[j], "v": matrix[i, j]})


def _each_system(systems: DataFrame, change, by: list[str]) -> DataFrame:
    """Each system's matrix through a function of dense matrices."""

    def run(key, rows):
        index = np.unique(np.concatenate([rows["i"], rows["j"]]))
        return _sparse(change(_dense(rows, index)), index, dict(zip(by, key)))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in systems.select(*by).schema)
    return systems.groupBy(*by).applyInPandas(run, f"{types}, {ENTRY}")


def cholesky(systems: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Upper factors W of N = W'W."""
    return _each_system(systems, lambda n: np.linalg.cholesky(n).T, by or ["sys_id"])


def inverse(systems: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _each_system(systems, np.linalg.inv, by or ["sys_id"])


def sparse_inverse(systems: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The inverse where the matrix itself has entries."""
    by = by or ["sys_id"]
    return inverse(systems, by).join(systems.select(*by, "i", "j").distinct(), [*by, "i", "j"], "left_semi")


def solve(systems: DataFrame, right: DataFrame, triangular: bool = False, transpose: bool = False) -> DataFrame:
    """x of N x = n (or of W x = n, W' x = n for upper factors W): rows (sys_id, i, x)."""

    def run(key, rows, side):
        index = np.unique(np.concatenate([rows["i"], rows["j"], side["i"]]))
        matrix, b = _dense(rows, index), np.zeros(len(index))
        b[np.searchsorted(index, side["i"])] = side["rhs"]
        matrix = matrix.T if transpose and triangular else matrix
        return pd.DataFrame({"sys_id": key[0], "i": index, "x": np.linalg.solve(matrix, b)})

    kind = systems.schema["sys_id"].dataType.simpleString()
    return systems.groupBy("sys_id").cogroup(right.groupBy("sys_id")).applyInPandas(run, f"sys_id {kind}, i long, x double")


def multiply(systems: DataFrame, vector: DataFrame, transpose: bool = False) -> DataFrame:
    """Rows (sys_id, i, x) of the matrix, or its transpose, times the vector (sys_id, i, x)."""
    row, column = ("j", "i") if transpose else ("i", "j")
    other = vector.select("sys_id", F.col("i").alias("_c"), "x")
    placed = systems.select("sys_id", F.col(row).alias("_r"), F.col(column).alias("_c"), "v")
    return placed.join(other, ["sys_id", "_c"]).groupBy("sys_id", F.col("_r").alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def symmetric(upper: DataFrame) -> DataFrame:
    """Both triangles from the upper one."""
    return upper.select("sys_id", "i", "j", "v").unionByName(upper.where("i != j").select("sys_id", F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def tikhonov(vector: DataFrame, bias: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matrix, right side and statistics of pseudo-observations of the parameters: weights (sys_id, i, w), biases (sys_id, i, x)."""
    known = vector if bias is None else vector.join(bias, ["sys_id", "i"], "left")
    x = F.lit(0.0) if bias is None else F.coalesce("x", F.lit(0.0))
    weighed = known.select("sys_id", "i", "w", x.alias("x"))
    matrix = weighed.select("sys_id", "i", F.col("i").alias("j"), F.col("w").alias("v"))
    right = weighed.select("sys_id", "i", (F.col("w") * F.col("x")).alias("rhs"))
    return matrix, right, weighed.groupBy("sys_id").agg(F.sum(F.col("w") * F.col("x") * F.col("x")).alias("lpl"), F.count("*").alias("obs"))


def residual_square_sums(systems: DataFrame, right: DataFrame, stats: DataFrame, solution: DataFrame) -> DataFrame:
    """Rows (sys_id, epe): l'Pl - 2 n'x + x'Nx of each system for its solution (sys_id, i, x)."""
    nx = multiply(systems, solution).withColumnRenamed("x", "nx")
    terms = solution.join(right, ["sys_id", "i"], "left").join(nx, ["sys_id", "i"], "left")
    zero = F.lit(0.0)
    sums = terms.groupBy("sys_id").agg(F.sum(F.col("x") * (F.coalesce("nx", zero) - 2 * F.coalesce("rhs", zero))).alias("_s"))
    return stats.join(sums, "sys_id", "left").select("sys_id", (F.col("lpl") + F.coalesce("_s", zero)).alias("epe"))


def posterior_sigmas(systems: DataFrame, right: DataFrame, stats: DataFrame, solution: DataFrame) -> DataFrame:
    counts = solution.groupBy("sys_id").agg(F.count("*").alias("_u"))
    epe = residual_square_sums(systems, right, stats, solution)
    return epe.join(stats, "sys_id").join(counts, "sys_id").select("sys_id", F.sqrt(F.col("epe") / (F.col("obs") - F.col("_u"))).alias("sigma"))


def redundancies(systems: DataFrame, stats: DataFrame, combined_inverse: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows (sys_id, redundancy): obs - tr(N_k N_c^-1) / sigma_k^2, with the exact trace."""
    trace = systems.join(combined_inverse.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("_w")), ["i", "j"]).groupBy("sys_id").agg(F.sum(F.col("v") * F.col("_w")).alias("_t"))
    return stats.join(trace, "sys_id", "left").join(factors, "sys_id").select("sys_id", (F.col("obs") - F.coalesce("_t", F.lit(0.0)) / F.col("factor")).alias("redundancy"))


def variance_components(systems: DataFrame, right: DataFrame, stats: DataFrame, iterations: int = 5, side: int = 512) -> tuple[DataFrame, DataFrame]:
    """The combined solution (i, x) and variance factors (sys_id, factor) of systems over the same parameters.

    The combined matrix is inverted by blocks of side numbers. A step's factors, a row a system, are checkpointed, so plans
    do not grow with the iterations.
    """
    factors = stats.select("sys_id", F.lit(1.0).alias("factor"))

    def combined():
        matrix = systems.join(factors, "sys_id").groupBy("i", "j").agg(F.sum(F.col("v") / F.col("factor")).alias("v"))
        known = right.join(factors, "sys_id").groupBy(F.col("i").alias("j")).agg(F.sum(F.col("rhs") / F.col("factor")).alias("rhs"))
        unit = matrix.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")).distinct()
        inverted = solve_positive(matrix, unit, side).checkpoint()
        return inverted, inverted.join(known, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("rhs")).alias("x"))

    for _ in range(iterations):
        inverted, x = combined()
        everywhere = right.select("sys_id", "i").join(x, "i").select("sys_id", "i", "x")
        epe = residual_square_sums(systems, right, stats, everywhere)
        r = redundancies(systems, stats, inverted, factors)
        factors = epe.join(r, "sys_id").select("sys_id", (F.col("epe") / F.col("redundancy")).alias("factor")).checkpoint()
    return combined()[1], factors


def robust(rows: DataFrame, columns: list[str], observed: str, threshold: float = 2.5, power: float = 1.5, iterations: int = 10, least_redundancy: float = 1e-4) -> tuple[list[float], np.ndarray, DataFrame]:
    """Iteratively down-weighted least squares: factors of the columns, their covariance, and rows with sigma and outlier.

    Each iteration is one pass of sums over the rows; only the normal equations of the columns, whose number the caller
    writes down, come to the driver. The weight of a row follows from the previous factors in closed form.
    """
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(p)]
    data = rows.withColumns({"_sigma": F.lit(1.0)})

    def state(weighed):
        w = 1 / (F.col("_sigma") * F.col("_sigma"))
        sums = weighed.agg(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs], *[F.sum(w * F.col(c) * F.col(observed)) for c in columns], F.sum(w * F.col(observed) * F.col(observed)), F.count("*")).first()
        n = np.array(sums[: p * p]).reshape(p, p)
        b = np.array(sums[p * p : p * p + p])
        c = np.linalg.inv(n)
        x = c @ b
        variance = (sums[-2] - b @ x) / (sums[-1] - p)
        return x, c, variance

    x, c, variance = state(data)
    for _ in range(iterations):
        fitted = sum((F.col(k) * float(v) for k, v in zip(columns, x)), F.lit(0.0))
        hat = sum((F.col(columns[i]) * F.col(columns[j]) * float(c[i, j]) for i, j in pairs), F.lit(0.0)) / (F.col("_sigma") * F.col("_sigma"))
        redundancy = 1 - hat
        size = F.abs(F.col(observed) - fitted) / F.sqrt(redundancy) / float(np.sqrt(variance))
        outlier = (size > threshold) & (redundancy > least_redundancy)
        data = data.withColumns({"_outlier": outlier, "_next": F.when(outlier, F.pow(size / threshold, F.lit(power))).otherwise(F.col("_sigma"))})
        data = data.select(*rows.columns, F.col("_next").alias("_sigma"), "_outlier").checkpoint()
        x, c, variance = state(data)
    return x.tolist(), c * variance, data.select(*rows.columns, F.col("_sigma").alias("sigma"), F.col("_outlier").alias("outlier"))


def top_eigenpairs(systems: DataFrame, count: int) -> DataFrame:
    """Rows (sys_id, rank, eigenvalue, i, v), largest first; the sign makes the largest entry positive."""

    def run(key, rows):
        index = np.unique(np.concatenate([rows["i"], rows["j"]]))
        values, vectors = np.linalg.eigh(_dense(rows, index))
        out = []
        for rank in range(min(count, len(index))):
            v = vectors[:, -1 - rank]
            v = v * np.sign(v[np.argmax(np.abs(v))])
            out.append(pd.DataFrame({"sys_id": key[0], "rank": rank, "eigenvalue": values[-1 - rank], "i": index, "v": v}))
        return pd.concat(out)

    kind = systems.schema["sys_id"].dataType.simpleString()
    return systems.groupBy("sys_id").applyInPandas(run, f"sys_id {kind}, rank int, eigenvalue double, i long, v double")


def sigma_points(mean: DataFrame, covariance: DataFrame, centre_weight: float) -> DataFrame:
    """Rows (sys_id, point, weight, i, x) of the symmetric set of 2 d + 1 points about each mean (sys_id, i, x)."""

    def run(key, rows, centre):
        index = centre["i"].sort_values().to_numpy()
        x = centre.set_index("i")["x"].loc[index].to_numpy()
        d = len(index)
        values, vectors = np.linalg.eigh(_dense(rows, index))
        spread = vectors * np.sqrt(np.maximum(values, 0) * d / (1 - centre_weight))
        points = np.vstack([x, x + spread.T, x - spread.T])
        weights = np.r_[centre_weight, np.full(2 * d, (1 - centre_weight) / (2 * d))]
        return pd.DataFrame({"sys_id": key[0], "point": np.repeat(np.arange(2 * d + 1), d), "weight": np.repeat(weights, d), "i": np.tile(index, 2 * d + 1), "x": points.ravel()})

    kind = mean.schema["sys_id"].dataType.simpleString()
    return covariance.groupBy("sys_id").cogroup(mean.groupBy("sys_id")).applyInPandas(run, f"sys_id {kind}, point int, weight double, i long, x double")


def moments_of_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean (sys_id, i, x) and centred covariance (sys_id, i, j, v) of weighted points."""
    mean = points.groupBy("sys_id", "i").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    centred = points.join(mean.withColumnRenamed("x", "_m"), ["sys_id", "i"]).select("sys_id", "point", "weight", "i", (F.col("x") - F.col("_m")).alias("x"))
    other = centred.select("sys_id", "point", F.col("i").alias("j"), F.col("x").alias("y"))
    return mean, centred.join(other, ["sys_id", "point"]).groupBy("sys_id", "i", "j").agg(F.sum(F.col("weight") * F.col("x") * F.col("y")).alias("v"))


def unscented(mean: DataFrame, covariance: DataFrame, change, alpha: float = 1e-3, kappa: float = 0.0, beta: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Mean and covariance after a change of the scaled sigma points.

    change makes rows (sys_id, point, i, x) of such rows; the central point is number 0.
    """
    counts = mean.groupBy("sys_id").agg(F.count("*").cast("double").alias("_d"))
    scale = F.lit(alpha**2) * (F.col("_d") + kappa)
    drawn = sigma_points(mean, covariance, 0.0)
    centre = mean.select("sys_id", "i", F.col("x").alias("_c"))
    spread = drawn.join(centre, ["sys_id", "i"]).join(F.broadcast(counts), "sys_id")
    # the points above lie sqrt(d) standard deviations off the mean; these lie sqrt(scale) off
    moved = spread.select("sys_id", "point", "i", (F.col("_c") + (F.col("x") - F.col("_c")) * F.sqrt(scale / F.col("_d"))).alias("x"))
    middle = F.col("point") == 0
    lam = scale - F.col("_d")
    weights = {"_wm": F.when(middle, lam / scale).otherwise(0.5 / scale), "_wc": F.when(middle, lam / scale + 1 - alpha**2 + beta).otherwise(0.5 / scale)}
    changed = change(moved).join(F.broadcast(counts), "sys_id").withColumns(weights)
    after = changed.groupBy("sys_id", "i").agg(F.sum(F.col("_wm") * F.col("x")).alias("x"))
    centred = changed.join(after.withColumnRenamed("x", "_m"), ["sys_id", "i"]).select("sys_id", "point", "i", "_wc", (F.col("x") - F.col("_m")).alias("x"))
    other = centred.select("sys_id", "point", F.col("i").alias("j"), F.col("x").alias("y"))
    spread = centred.join(other, ["sys_id", "point"]).groupBy("sys_id", "i", "j").agg(F.sum(F.col("_wc") * F.col("x") * F.col("y")).alias("v"))
    return after, spread
