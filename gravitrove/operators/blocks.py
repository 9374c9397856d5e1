"""Matrices as rows (r, c, data) of dense square blocks: factors and solutions of systems too large for one task.

Each step of the elimination is a join of one column of blocks with itself or with the rest; what a task holds is a few
blocks of side x side numbers, whatever the size of the matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

BLOCK = "r long, c long, data binary"


def _read(data: bytes, side: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(side, side)


def _map(rows: DataFrame, change) -> DataFrame:
    """Blocks made of each row; change takes a row and gives a matrix."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):  # one block at a time
                x = batch.iloc[i]
                yield pd.DataFrame({"r": [x["r"]], "c": [x["c"]], "data": [np.ascontiguousarray(change(x), "<f8").tobytes()]})

    return rows.mapInPandas(run, BLOCK)


def to_blocks(matrix: DataFrame, side: int, positive: bool = False) -> DataFrame:
    """Blocks of rows (i, j, v), repeated entries added up; positive: a number without an entry on the diagonal gets 1 there."""

    def run(key, rows):
        block = np.zeros((side, side))
        np.add.at(block, (rows["i"] % side, rows["j"] % side), rows["v"])
        if positive and key[0] == key[1]:
            here = np.zeros(side, bool)
            here[rows["i"][rows["i"] == rows["j"]] % side] = True
            block[np.flatnonzero(~here), np.flatnonzero(~here)] = 1.0
        return pd.DataFrame({"r": [key[0]], "c": [key[1]], "data": [block.astype("<f8").tobytes()]})

    rows = matrix.select(F.floor(F.col("i") / side).alias("r"), F.floor(F.col("j") / side).alias("c"), "i", "j", "v")
    return rows.groupBy("r", "c").applyInPandas(run, BLOCK)


def to_entries(blocks: DataFrame, side: int) -> DataFrame:
    """Rows (i, j, v) of what is not 0."""

    def run(batches):
        for batch in batches:
            for r, c, data in zip(batch["r"], batch["c"], batch["data"]):
                block = _read(data, side)
                i, j = np.nonzero(block)
                yield pd.DataFrame({"i": r * side + i, "j": c * side + j, "v": block[i, j]})

    return blocks.mapInPandas(run, "i long, j long, v double")


def _less_products(blocks: DataFrame, left: DataFrame, right: DataFrame, columns: list[int], side: int, transpose: tuple[bool, bool], lower: bool = False) -> DataFrame:
    """blocks less the product of each left block (r, a) with each right block (c, b) of the columns named, either transposed.

    A left block is dealt to the columns it meets (lower: those up to its row), so that the join is on equal keys.
    """
    dealt = left.withColumn("c", F.explode(F.array(*[F.lit(c).cast("long") for c in columns]))) if columns else left.withColumn("c", F.lit(0).cast("long")).limit(0)
    pairs = (dealt.where("r >= c") if lower else dealt).join(right, "c").select("r", "c", "a", "b")

    def change(x):
        a, b = (_read(x[n], side).T if t else _read(x[n], side) for n, t in zip("ab", transpose))
        return -(a @ b)

    products = _map(pairs, change).withColumnRenamed("data", "less")
    both = blocks.join(products, ["r", "c"], "full")
    one = F.coalesce("data", "less").alias("data")
    summed = _map(both.where("data is not null and less is not null"), lambda x: _read(x["data"], side) + _read(x["less"], side))
    return both.where("data is null or less is null").select("r", "c", one).unionByName(summed)


def cholesky(blocks: DataFrame, side: int) -> DataFrame:
    """The lower factor L of a symmetric positive definite matrix LL', block column by block column."""
    rest = stored(blocks.where("r >= c"))
    done = None
    numbers = [x.r for x in rest.where("r = c").select("r").sort("r").collect()]  # one a block column
    for k in numbers:
        head = rest.where((F.col("r") == k) & (F.col("c") == k)).select("c", F.col("data").alias("head"))

        def factor(x):
            lower = np.linalg.cholesky(_read(x["head"], side))
            return lower if x["r"] == x["c"] else np.linalg.solve(lower, _read(x["data"], side).T).T

        column = stored(_map(rest.where(F.col("c") == k).join(head, "c"), factor))
        done = column if done is None else done.unionByName(column)
        below = column.where(F.col("r") > k)
        left, right = below.select("r", F.col("data").alias("a")), below.select(F.col("r").alias("c"), F.col("data").alias("b"))
        rest = stored(_less_products(rest.where(F.col("c") > k), left, right, [x for x in numbers if x > k], side, (False, True), lower=True))
    return rest.limit(0) if done is None else done


def solve_lower(lower: DataFrame, right: DataFrame, side: int, transpose: bool = False) -> DataFrame:
    """X of LX = B or L'X = B for blocks of L and B."""
    rest, done = right, None
    columns = [x.c for x in right.select("c").distinct().collect()]  # one a block column
    for k in [x.r for x in lower.where("r = c").select("r").sort("r", ascending=not transpose).collect()]:
        head = lower.where((F.col("r") == k) & (F.col("c") == k)).select("r", F.col("data").alias("head"))

        def substituted(x):
            block = _read(x["head"], side)
            return np.linalg.solve(block.T if transpose else block, _read(x["data"], side))

        row = stored(_map(rest.where(F.col("r") == k).join(head, "r"), substituted))
        done = row if done is None else done.unionByName(row)
        near, far = ("r", "c") if transpose else ("c", "r")
        left = lower.where((F.col(near) == k) & (F.col("r") != F.col("c"))).select(F.col(far).alias("r"), F.col("data").alias("a"))
        rest = stored(_less_products(rest.where(F.col("r") != k), left, row.select("c", F.col("data").alias("b")), columns, side, (transpose, False)))
    return right.limit(0) if done is None else done


def solve_positive(matrix: DataFrame, right: DataFrame, side: int = 512) -> DataFrame:
    """Rows (i, j, v) of N^-1 B for rows of a symmetric positive definite N and of B; entries of 0 are left out.

    Rows of B whose number N does not have are dropped; an empty N gives no rows.
    """
    lower = cholesky(to_blocks(matrix, side, positive=True), side)
    known = matrix.select("i").distinct()
    sides = to_blocks(right.join(known, "i", "left_semi"), side)
    return to_entries(solve_lower(lower, solve_lower(lower, sides, side), side, transpose=True), side)
