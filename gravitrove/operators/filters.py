"""Filters that mix the degrees of an order, or all coefficients, as sparse matrices joined to a field."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adjustment import _dense, _sparse
from .blocks import solve_positive

#: The scales of the eight levels of the decorrelation filter.
DDK_SCALES = {1: 1e14, 2: 1e13, 3: 1e12, 4: 5e11, 5: 1e11, 6: 5e10, 7: 1e10, 8: 5e9}


def regularised_blocks(normals: DataFrame, scale: float, power: float) -> DataFrame:
    """(N + scale n^power)^-1 N of each order's normal matrix: rows (m, trig, i, j, v) in and out, i and j degrees.

    The weight of degree 0 is 1. Orders run side by side; a block has as many rows as there are degrees.
    """

    def run(key, rows):
        index = np.unique(np.concatenate([rows["i"], rows["j"]]))
        n = _dense(rows, index)
        weight = np.where(index > 0, scale * np.maximum(index, 1).astype(float) ** power, 1.0)
        return _sparse(np.linalg.solve(n + np.diag(weight), n), index, {"m": key[0], "trig": key[1]})

    return normals.groupBy("m", "trig").applyInPandas(run, "m int, trig int, i int, j int, v double")


def ddk(normals: DataFrame, level: int, generic: bool = False) -> DataFrame:
    """Blocks of the decorrelation filter; generic levels halve no scale but follow powers of ten."""
    if level < 1 or (not generic and level not in DDK_SCALES):
        raise ValueError(f"no level {level}")
    return regularised_blocks(normals, 10.0 ** (15 - level) if generic else DDK_SCALES[level], 4.0)


def order_wise(field: DataFrame, blocks: DataFrame) -> DataFrame:
    """The field filtered by blocks (m, trig, i, j, v); degrees 0 and 1 stay as they are."""
    top, highest = blocks.agg(F.max("j")).first()[0], field.agg(F.max("n")).first()[0]
    if None not in (top, highest) and highest > top:
        raise ValueError("the field's degree is above the filter's")
    product = field.join(blocks.withColumnRenamed("j", "n"), ["m", "trig", "n"]).where("i >= 2")
    filtered = product.groupBy("epoch", F.col("i").alias("n"), "m", "trig").agg(F.sum(F.col("v") * F.col("value")).alias("value"))
    return field.where("n < 2").select("epoch", "n", "m", "trig", "value").unionByName(filtered)


def regularised(normals: DataFrame, scale: float, power: float, order_wise_only: bool = False, side: int = 512) -> DataFrame:
    """(N + scale n^power)^-1 N of one full normal matrix, rows (i_n, i_m, i_trig, n, m, trig, v) in and out.

    Solved by blocks of side numbers, so no task holds the square of (degree + 1)^2. order_wise_only keeps the entries
    within an order, cosine or sine.
    """
    packed = [F.col(p + "n") * F.col(p + "n") + F.when(F.col(p + "m") == 0, 0).otherwise(2 * F.col(p + "m") - 1 + F.col(p + "trig")) for p in ("i_", "")]
    rows = normals.select(packed[0].cast("long").alias("i"), packed[1].cast("long").alias("j"), "v")
    weight = F.lit(float(scale)) * F.pow(F.floor(F.sqrt("i")).cast("double"), F.lit(float(power)))
    solved = solve_positive(rows.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), weight).otherwise(0.0)), rows, side)
    names = {}
    for prefix, c in (("i_", "i"), ("", "j")):
        n = F.floor(F.sqrt(c)).cast("int")
        rest = F.col(c) - n * n
        names |= {prefix + "n": n, prefix + "m": F.floor((rest + 1) / 2).cast("int"), prefix + "trig": F.when(rest == 0, 0).otherwise((rest + 1) % 2).cast("int")}
    full = solved.select(*[v.alias(k) for k, v in names.items()], "v")
    return full.where("i_m = m and i_trig = trig") if order_wise_only else full


def blocks_of(normals: DataFrame) -> DataFrame:
    """The order-wise blocks (m, trig, i, j, v) of a full matrix."""
    return normals.where("i_m = m and i_trig = trig").select("m", "trig", F.col("i_n").alias("i"), F.col("n").alias("j"), "v")


def filter_kernel(matrix: DataFrame, kernel, inverse_kernel) -> DataFrame:
    """The filter between values of a kernel: v k(i) / k(n); kernel and inverse_kernel make a column of a degree column."""
    scaled: Column = F.col("v") * inverse_kernel(F.col("i_n")) * kernel(F.col("n"))
    return matrix.withColumn("v", scaled)
