"""Vector autoregressive models: covariances of samples on Spark, the small model equations with NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elimination import eliminate, from_entries, solve, summed, to_entries


def lagged_covariances(sample: DataFrame, max_lag: int) -> DataFrame:
    """Rows (lag, i, j, v): mean of x_i(t + lag) x_j(t) over whole steps t of a sample (t, i, x)."""
    early = sample.select(F.col("t"), F.col("i").alias("j"), F.col("x").alias("y"))
    late = sample.select("t", "i", "x", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).withColumn("t", F.col("t") - F.col("lag"))
    return late.join(early, "t").groupBy("lag", "i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("v"))


class Model:
    """x(t) = B_1 x(t - 1) + ... + B_p x(t - p) + w, with covariance Q of w."""

    def __init__(self, coefficients, noise):
        self.coefficients = [np.asarray(b, float) for b in coefficients]
        self.noise = np.atleast_2d(np.asarray(noise, float))
        self.order, self.dimension = len(self.coefficients), self.noise.shape[0]

    @classmethod
    def from_covariances(cls, covariances) -> Model:
        """By the Yule-Walker equations; entry k is E x(t + k) x(t)'."""
        c = [np.atleast_2d(np.asarray(x, float)) for x in covariances]
        p = len(c) - 1
        if not p:
            return cls([], c[0])
        left = np.block([[c[col - row] if col >= row else c[row - col].T for col in range(p)] for row in range(p)])
        b = np.linalg.solve(left.T, np.hstack(c[1:]).T).T
        return cls(np.split(b, p, axis=1), c[0] - b @ np.vstack([x.T for x in c[1:]]))

    @classmethod
    def from_sample(cls, sample: DataFrame, order: int) -> Model:
        """From a sample (t, i, x); the covariances, (order + 1) times the squared dimension, come to the driver."""
        rows = lagged_covariances(sample, order).collect()
        d = 1 + max(r["i"] for r in rows)
        c = np.zeros((order + 1, d, d))
        for r in rows:
            c[r["lag"], r["i"], r["j"]] = r["v"]
        return cls.from_covariances(c)

    def companion(self) -> Model:
        """The same process as a model of order one in the stacked state."""
        if self.order == 1:
            return self
        d, p = self.dimension, self.order
        b, q = np.eye(d * p, k=-d), np.zeros((d * p, d * p))
        b[:d], q[:d, :d] = np.hstack(self.coefficients), self.noise
        return Model([b], q)

    def covariances(self, max_lag: int) -> np.ndarray:
        one = self.companion()
        b, d = one.coefficients[0], one.dimension
        state = np.linalg.solve(np.eye(d * d) - np.kron(b, b), one.noise.ravel()).reshape(d, d)
        found = []
        for _ in range(max_lag + 1):
            found.append(state[: self.dimension, : self.dimension])
            state = b @ state
        return np.array(found)

    def normals(self) -> np.ndarray:
        """Normal matrix of the pseudo-observation 0 = B_p x(t - p) + ... + B_1 x(t - 1) - x(t)."""
        rows = np.hstack([*self.coefficients[::-1], -np.eye(self.dimension)])
        return rows.T @ np.linalg.solve(self.noise, rows)

    def transformed(self) -> np.ndarray:
        """Coefficients of decorrelated equations: -W B_p, ..., -W B_1, W with W'W the inverse noise covariance."""
        w = np.linalg.inv(np.linalg.cholesky(self.noise))
        return np.hstack([*(-w @ b for b in self.coefficients[::-1]), w])

    @classmethod
    def from_transformed(cls, rows: np.ndarray) -> Model:
        d = rows.shape[0]
        root = np.linalg.inv(rows[:, -d:])
        return cls([-root @ x for x in np.split(rows[:, :-d], rows.shape[1] // d - 1, axis=1)][::-1], root @ root.T)

    def spectrum(self, frequencies: DataFrame) -> DataFrame:
        """Rows (frequency, i, psd) of the components' densities, for rows (frequency) in cycles a step."""
        blocks, noise, d = self.coefficients, self.noise, self.dimension

        def run(batches):
            for batch in batches:
                f = batch["frequency"].to_numpy()
                a = np.eye(d) - sum((b * np.exp(-2j * np.pi * f * (k + 1))[:, None, None] for k, b in enumerate(blocks)), np.zeros((len(f), d, d), complex))
                t = np.linalg.solve(a, np.broadcast_to(np.linalg.cholesky(noise).astype(complex), a.shape))
                psd = (np.abs(t) ** 2).sum(axis=2)
                yield batch.loc[batch.index.repeat(d)].assign(i=np.tile(np.arange(d), len(f)), psd=psd.ravel())

        return frequencies.select("frequency").mapInPandas(run, "frequency double, i int, psd double")


def sequence(covariances) -> list[Model]:
    """Models of order 0, 1, ... from covariances of lags 0, 1, ..."""
    return [Model.from_covariances(covariances[: k + 1]) for k in range(len(covariances))]


def sequence_blocks(spark: SparkSession, models: list[Model], epochs: int) -> DataFrame:
    """Block-banded normals of a time line from models of order 0, 1, ..., p: early epochs use the lower orders.

    Each epoch adds its model's blocks at its own and the epochs before; a block of the band is a sum of at most p + 1 of them.
    The blocks are those of elimination.py, one a pair of epochs; nothing holds more than a model.
    """
    d, parts = models[0].dimension, []
    for model in models:
        normals = model.normals()
        parts += [(model.order, a, b, d, d, np.ascontiguousarray(normals[a * d : (a + 1) * d, b * d : (b + 1) * d], "<f8").tobytes()) for a in range(model.order + 1) for b in range(model.order + 1)]
    pieces = spark.createDataFrame(parts, "p int, a int, b int, n_rows int, n_cols int, data binary")
    line = spark.range(epochs).select(F.col("id").alias("t"), F.least(F.col("id"), F.lit(len(models) - 1)).cast("int").alias("p"))
    each = line.join(pieces, "p").select((F.col("t") - F.col("p") + F.col("a")).alias("r"), (F.col("t") - F.col("p") + F.col("b")).alias("c"), "n_rows", "n_cols", "data")
    return summed(each)


def sequence_covariances(spark: SparkSession, models: list[Model], max_lag: int, side: int = 256) -> DataFrame:
    """Rows (lag, i, j, v): covariances of the first epoch with the later ones, out of the inverse of the normals of max_lag + 1 epochs.

    Blocks of about `side` numbers, whole epochs and no fewer than the models' order, make the band block-tridiagonal: the
    elimination takes a number of rounds that grows with the logarithm of max_lag.
    """
    d, epochs = models[0].dimension, max(max_lag + 1, len(models))
    side = d * max(side // d, len(models) - 1, 1)
    factors = eliminate(from_entries(to_entries(sequence_blocks(spark, models, epochs), d), side))
    unit = spark.createDataFrame([(k, k, 1.0) for k in range(d)], "i long, j long, v double")
    found = to_entries(solve(factors, from_entries(unit.unionByName(spark.createDataFrame([(epochs * d - 1, 0, 0.0)], unit.schema)), side)), side).where(F.col("j") < d)
    rows = found.select(F.floor(F.col("i") / d).alias("lag"), F.col("j").cast("int").alias("i"), (F.col("i") % d).cast("int").alias("j"), "v")
    return rows.where(F.col("lag") <= max_lag)
