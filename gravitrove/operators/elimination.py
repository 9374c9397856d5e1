"""Symmetric positive definite matrices with a pattern of blocks: rows (r, c, n_rows, n_cols, data), both triangles; absent blocks are 0.

Block columns that share no block are eliminated side by side: each round takes an independent set of the pattern's graph, those
of fewest blocks first, and adds the blocks that it fills. Of a block-banded matrix that is odd-even reduction, so the rounds
grow with the logarithm of its length. A task holds one block column of the pattern and the products of its blocks.
The inverse on the filled pattern comes from the rounds backwards, and no block outside it is formed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

BLOCK = "r long, c long, n_rows int, n_cols int, data binary"
STEP = "k long, i long, kind string, r long, c long, n_rows int, n_cols int, data binary"


class Elimination(NamedTuple):
    """Of each round, rows (k, i, n_rows, n_cols, data): A_ik / A_kk for i != k, and the inverse of A_kk for i = k."""

    rounds: list[DataFrame]


def _read(row) -> np.ndarray:
    return np.frombuffer(row["data"], "<f8").reshape(row["n_rows"], row["n_cols"])


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8").tobytes()


def from_entries(matrix: DataFrame, side: int) -> DataFrame:
    """Blocks of rows (i, j, v), repeated entries added up; the last block row and column hold what is left."""
    total = (matrix.agg(F.greatest(F.max("i"), F.max("j"))).first()[0] or 0) + 1

    def run(key, rows):
        shape = [int(min(side, total - k * side)) for k in key]
        block = np.zeros(shape)
        np.add.at(block, (rows["i"] % side, rows["j"] % side), rows["v"])
        return pd.DataFrame({"r": [key[0]], "c": [key[1]], "n_rows": shape[:1], "n_cols": shape[1:], "data": [_bytes(block)]})

    return matrix.select(F.floor(F.col("i") / side).alias("r"), F.floor(F.col("j") / side).alias("c"), "i", "j", "v").groupBy("r", "c").applyInPandas(run, BLOCK)


def to_entries(blocks: DataFrame, side: int) -> DataFrame:
    """Rows (i, j, v) of every number of the blocks, zeros included."""

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                i, j = np.indices((row["n_rows"], row["n_cols"])).reshape(2, -1)
                yield pd.DataFrame({"i": row["r"] * side + i, "j": row["c"] * side + j, "v": _read(row).ravel()})

    return blocks.mapInPandas(run, "i long, j long, v double")


def summed(blocks: DataFrame) -> DataFrame:
    """Blocks of one place added up, as they come sorted past; a task holds one sum at a time."""
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches):
        held, total = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if held and (held["r"], held["c"]) == (row["r"], row["c"]):
                    total = total + _read(row)
                    continue
                if held:
                    out.append({**held, "data": _bytes(total)})
                held, total = row, _read(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([{**held, "data": _bytes(total)}], columns=names)

    return blocks.select(names).repartition("r", "c").sortWithinPartitions("r", "c").mapInPandas(run, BLOCK)


def _independent(blocks: DataFrame, turn: int) -> DataFrame:
    """Rows (k): columns that come before all they share a block with, by the number of their blocks and a hash of the round."""
    edges = blocks.where("r != c").select("r", "c")
    rank = blocks.groupBy(F.col("r").alias("k")).agg(F.struct(F.count("*").alias("n"), F.xxhash64("k", F.lit(turn)).alias("h"), F.col("k")).alias("rank"))
    met = edges.join(rank.select(F.col("k").alias("r"), F.col("rank").alias("own")), "r").join(rank.select(F.col("k").alias("c"), F.col("rank").alias("other")), "c")
    return rank.select("k").join(met.where("other < own").select(F.col("r").alias("k")), "k", "left_anti")


def eliminate(blocks: DataFrame) -> Elimination:
    """The rounds of the elimination of a matrix with its diagonal blocks present."""

    def run(key, rows):
        k, column = int(key[0]), {int(x["r"]): _read(x) for x in rows.to_dict("records")}
        inverse = np.linalg.inv(column.pop(k))
        inverse = (inverse + inverse.T) / 2
        shares = {i: a @ inverse for i, a in column.items()}
        out = [(k, k, "share", k, k, *inverse.shape, _bytes(inverse))]
        out += [(k, i, "share", i, k, *g.shape, _bytes(g)) for i, g in shares.items()]
        out += [(k, i, "change", i, j, g.shape[0], a.shape[0], _bytes(-g @ a.T)) for i, g in shares.items() for j, a in column.items()]
        return pd.DataFrame(out, columns=[x.split()[0] for x in STEP.split(", ")])

    rounds, rest, turn = [], stored(blocks), 0
    while not rest.isEmpty():
        chosen = stored(_independent(rest, turn))
        column = rest.join(chosen.select(F.col("k").alias("c")), "c", "left_semi").withColumn("k", F.col("c"))
        step = stored(column.groupBy("k").applyInPandas(run, STEP))
        rounds.append(step.where("kind = 'share'").select("k", "i", "n_rows", "n_cols", "data"))
        left = rest.join(chosen.select(F.col("k").alias("c")), "c", "left_anti").join(chosen.select(F.col("k").alias("r")), "r", "left_anti")
        changes = step.where("kind = 'change'").select("r", "c", "n_rows", "n_cols", "data")
        rest = stored(summed(left.select(changes.columns).unionByName(changes)))
        turn += 1
    return Elimination(rounds)


def _products(pairs: DataFrame, left_transposed: bool, sign: float) -> DataFrame:
    """Blocks (r, c) that are sign times the product of the struct columns a and b."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                a, b = _read(row["a"]), _read(row["b"])
                x = sign * ((a.T if left_transposed else a) @ b)
                out.append((row["r"], row["c"], *x.shape, _bytes(x)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])

    return pairs.mapInPandas(run, BLOCK)


_DATA = ("n_rows", "n_cols", "data")


def solve(factors: Elimination, right: DataFrame) -> DataFrame:
    """X of AX = B for blocks of B, whatever the number of their columns: rows of BLOCK."""
    rest, eliminated = stored(right), []
    data = F.struct(*_DATA)
    for step in factors.rounds:
        here = stored(rest.join(step.select(F.col("k").alias("r")).distinct(), "r", "left_semi").select(F.col("r").alias("k"), "c", data.alias("b")))
        eliminated.append(here)
        less = _products(step.where("i != k").select("k", F.col("i").alias("r"), data.alias("a")).join(here, "k"), False, -1.0)
        others = rest.join(step.select(F.col("k").alias("r")).distinct(), "r", "left_anti").select("r", "c", *_DATA)
        rest = stored(summed(others.unionByName(less)))
    found = right.limit(0).select("r", "c", *_DATA)
    for step, here in zip(reversed(factors.rounds), reversed(eliminated)):
        own = _products(step.where("i = k").select("k", F.col("i").alias("r"), data.alias("a")).join(here, "k"), False, 1.0)
        above = step.where("i != k").select("k", "i", data.alias("a")).join(found.select(F.col("r").alias("i"), "c", data.alias("b")), "i")
        back = _products(above.withColumn("r", F.col("k")), True, -1.0)
        found = stored(found.unionByName(summed(own.unionByName(back))))
    return found


def sparse_inverse(factors: Elimination) -> DataFrame:
    """The blocks of the inverse on the filled pattern, both triangles."""
    data, found = F.struct(*_DATA), None
    for step in reversed(factors.rounds):
        shares = step.where("i != k").select("k", "i", data.alias("b"))
        own = step.where("i = k").select(F.col("k").alias("r"), F.col("k").alias("c"), *_DATA)
        if found is None:
            found = stored(own)
            continue
        # Z_ik = - sum_j Z_ij G_jk over the blocks of the column, which the fill has made a clique; Z_kk = D - sum_i G_ik' Z_ik
        pairs = shares.select("k", F.col("i").alias("j"), "b").join(shares.select("k", "i"), "k")
        known = found.select(F.col("r").alias("i"), F.col("c").alias("j"), data.alias("a"))
        beside = stored(summed(_products(pairs.join(known, ["i", "j"]).select(F.col("i").alias("r"), F.col("k").alias("c"), "a", "b"), False, -1.0)))
        across = shares.select("k", "i", F.col("b").alias("a")).join(beside.select(F.col("r").alias("i"), F.col("c").alias("k"), data.alias("b")), ["k", "i"])
        own = summed(own.unionByName(_products(across.select(F.col("k").alias("r"), F.col("k").alias("c"), "a", "b"), True, -1.0)))
        found = stored(found.unionByName(beside).unionByName(_turned(beside)).unionByName(own))
    return found


def _turned(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [(row["c"], row["r"], row["n_cols"], row["n_rows"], _bytes(_read(row).T)) for row in batch.to_dict("records")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])

    return blocks.mapInPandas(run, BLOCK)


def sparse_inverse_entries(matrix: DataFrame, side: int = 64) -> DataFrame:
    """Rows (i, j, v) of the inverse where the matrix (i, j, v), both triangles given, has entries itself."""
    found = sparse_inverse(eliminate(from_entries(matrix, side)))
    return to_entries(found, side).join(matrix.select("i", "j").distinct(), ["i", "j"], "left_semi")


def log_determinant(factors: Elimination) -> float:
    """A sum over the diagonal blocks."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"v": [-np.linalg.slogdet(_read(row))[1] for row in batch.to_dict("records")]}, dtype=float)

    whole = reduce(DataFrame.unionByName, [s.where("i = k") for s in factors.rounds])
    return whole.mapInPandas(run, "v double").agg(F.sum("v")).first()[0]
