"""Sparse matrices in coordinate form: rows (i, j, v)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Rows of a block of a tall matrix at least, and factors stacked at a time.
BLOCK_ROWS, FAN = 4096, 8


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(right, "j").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def normals(a: DataFrame) -> DataFrame:
    """A'A from one pass over rows: each row of A is gathered once and gives the products of its own entries, summed on the map side."""
    rows = a.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("row"))
    left = rows.select("row", F.explode("row").alias("x"))
    return left.select(F.col("x.j").alias("i"), F.col("x.v").alias("u"), F.explode("row").alias("y")).groupBy("i", F.col("y.j").alias("j")).agg(F.sum(F.col("u") * F.col("y.v")).alias("v"))


def add_scaled(a: DataFrame, factor: float, b: DataFrame) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select("i", "j", (factor * F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def accumulate(systems: DataFrame, factors: DataFrame) -> DataFrame:
    """Sum of the systems' matrices over their variance factors: rows (sys_id, i, j, v) and (sys_id, factor)."""
    return systems.join(factors, "sys_id").groupBy("i", "j").agg(F.sum(F.col("v") / F.col("factor")).alias("v"))


def _factor(data: list[bytes], columns: int) -> bytes:
    stacked = np.vstack([np.frombuffer(x, "<f8").reshape(-1, columns) for x in data])
    return np.ascontiguousarray(np.linalg.qr(stacked, mode="r"), "<f8").tobytes()


def triangular_factor(a: DataFrame, columns: int) -> DataFrame:
    """One row (data): R of A = QR for rows (i, j, v) with j below columns, without A'A, so small singular values keep their digits.

    Rows are dealt into blocks by a hash; each block has a factor of its own, and eight factors at a time are stacked and factored
    again, over a number of rounds that grows with the logarithm of the rows. A task holds a block or eight factors.
    """
    height = max(BLOCK_ROWS, 2 * columns)
    blocks = 1 + (a.select("i").distinct().count() // height)

    def dense(key, rows):
        number, at = np.unique(rows["i"], return_inverse=True)
        block = np.zeros((len(number), columns))
        np.add.at(block, (at, rows["j"]), rows["v"])
        return pd.DataFrame({"block": [key[0]], "data": [_factor([block.tobytes()], columns)]})

    def stacked(key, rows):
        return pd.DataFrame({"block": [key[0]], "data": [_factor(rows.sort_values("block")["data"].tolist(), columns)]})

    found = stored(a.select(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("block"), "i", "j", "v").groupBy("block").applyInPandas(dense, "block long, data binary"))
    while blocks > 1:
        blocks = -(-blocks // FAN)
        found = stored(found.groupBy(F.floor(F.col("block") / FAN).alias("group")).applyInPandas(stacked, found.schema))
    return found.select("data")


def _right_side(a: DataFrame, columns: int, count: int) -> DataFrame:
    """Rows (rank, sigma, j, v) from the factor, whose side is the number of columns; the largest entry of a vector is positive."""

    def run(batches):
        for batch in batches:
            for data in batch["data"]:
                _, sigma, vectors = np.linalg.svd(np.frombuffer(data, "<f8").reshape(-1, columns))
                sigma = np.concatenate([sigma, np.zeros(columns - len(sigma))])
                for rank in range(min(count, columns)):
                    v = vectors[rank] * np.sign(vectors[rank][np.argmax(np.abs(vectors[rank]))])
                    yield pd.DataFrame({"rank": rank, "sigma": sigma[rank], "j": np.arange(columns), "v": v})

    return stored(triangular_factor(a, columns).mapInPandas(run, "rank int, sigma double, j long, v double"))


def _projected(a: DataFrame, width: int, rounds: int) -> DataFrame:
    """Rows (i, l, v) of a basis of width columns near to the range of A: A times pseudo-random numbers, with power iterations."""
    normal = F.sqrt(-2 * F.log((F.pmod(F.xxhash64("j", "l", F.lit(1)), F.lit(1 << 40)) + 1) / float(1 << 40))) * F.cos(F.pmod(F.xxhash64("j", "l", F.lit(2)), F.lit(1 << 40)) * (2 * math.pi / (1 << 40)))
    drawn = a.select("j").distinct().withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("w", normal)
    turned = a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    basis = _orthonormal(multiply(a, drawn.select(F.col("j").alias("i"), F.col("l").alias("j"), F.col("w").alias("v"))), width)
    for _ in range(rounds):
        basis = _orthonormal(multiply(a, _orthonormal(multiply(turned, basis), width)), width)
    return basis


def _orthonormal(y: DataFrame, width: int) -> DataFrame:
    """Y R^-1, twice, since the first time leaves what rounding in R^-1 adds."""
    for _ in range(2):
        y = stored(y)

        def inverse(batches):
            for batch in batches:
                for data in batch["data"]:
                    r = np.linalg.pinv(np.frombuffer(data, "<f8").reshape(-1, width), 1e-15)
                    i, j = np.indices(r.shape).reshape(2, -1)
                    yield pd.DataFrame({"i": i, "j": j, "v": r.ravel()})

        y = multiply(y, triangular_factor(y, width).mapInPandas(inverse, "i long, j long, v double"))
    return stored(y)


def truncated_svd(a: DataFrame, count: int, oversampling: int = 10, rounds: int = 5, most_columns: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The `count` largest singular values of rows (i, j, v): (rank, sigma), (rank, j, v) and (rank, i, u).

    Of a matrix of at most most_columns columns, all comes from its triangular factor. Of a wider one, a random
    projection with `rounds` power iterations finds a basis of count + oversampling columns first, and the factor is that of the
    projected matrix, turned. Values that are 0 have no left vector.
    """
    columns = (a.agg(F.max("j")).first()[0] or 0) + 1
    if columns <= most_columns:
        pairs = _right_side(a, columns, count)
        right = pairs.select("rank", "j", "v")
    else:
        width = count + oversampling
        basis = _projected(a, width, rounds)
        small = stored(multiply(basis.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a).select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))  # (Q'A)'
        pairs = _right_side(small, width, count)
        both = small.withColumnRenamed("v", "entry").join(pairs, "j")
        right = both.where("sigma > 0").groupBy("rank", F.col("i").alias("j")).agg((F.sum(F.col("entry") * F.col("v")) / F.first("sigma")).alias("v"))
    values = pairs.select("rank", "sigma").distinct()
    products = a.withColumnRenamed("v", "entry").join(right, "j").groupBy("rank", "i").agg(F.sum(F.col("entry") * F.col("v")).alias("p"))
    left = products.join(values, "rank").where("sigma > 0").select("rank", "i", (F.col("p") / F.col("sigma")).alias("u"))
    return values, right, left
