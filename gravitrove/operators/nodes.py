"""Fields given by values at nodes: radial basis functions and surface mascons.

Nodes are rows (point_id, lon, lat), values rows (epoch, point_id, value), shape factors rows (n, m, trig, k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grids import compatible
from .synthesis import basis_matrix, synthesise


def coefficient_matrix(nodes: DataFrame, shape: DataFrame, max_degree: int, min_degree: int = 0, ratio: Column | float = 1.0) -> DataFrame:
    """Rows (n, m, trig, point_id, v) that turn the nodes' values into coefficients.

    ratio, a column of nodes, is the reference radius over the node's; it counts to the power n + 1.
    """
    scaled = nodes.select("point_id", (ratio if isinstance(ratio, Column) else F.lit(ratio)).alias("ratio"))
    basis = basis_matrix(nodes, max_degree).where(F.col("n") >= min_degree).join(scaled, "point_id")
    return basis.join(shape, ["n", "m", "trig"]).select("n", "m", "trig", "point_id", (F.col("v") * F.col("k") * F.pow("ratio", F.col("n") + 1.0)).alias("v"))


def to_coefficients(values: DataFrame, nodes: DataFrame, shape: DataFrame, max_degree: int, min_degree: int = 0, ratio: Column | float = 1.0) -> DataFrame:
    """Rows (epoch, n, m, trig, value): the sum of the nodes' values times their basis functions."""
    matrix = coefficient_matrix(nodes, shape, max_degree, min_degree, ratio)
    return values.join(matrix, "point_id").groupBy("epoch", "n", "m", "trig").agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def to_grid(values: DataFrame, nodes: DataFrame, shape: DataFrame, points: DataFrame, max_degree: int, weight: Column | None = None) -> DataFrame:
    """Rows (epoch, point_id, value) of the basis functions at points, by way of their coefficients."""
    return synthesise(to_coefficients(values, nodes, shape, max_degree), points, max_degree, weight)


def combine(left: DataFrame, right: DataFrame, sign: int = 1) -> DataFrame:
    """Values of mascon fields added (or, with sign -1, subtracted) node by node; both hold the same epochs and nodes."""
    other = right.select("epoch", "point_id", F.col("value").alias("_other"))
    return left.join(other, ["epoch", "point_id"]).select("epoch", "point_id", (F.col("value") + sign * F.col("_other")).alias("value"))


def combined_on_same_nodes(left: DataFrame, right: DataFrame, left_nodes: DataFrame, right_nodes: DataFrame, sign: int = 1) -> DataFrame:
    """combine(), after a check that both fields stand on the same nodes."""
    if not compatible(left_nodes, right_nodes).first()["compatible"]:
        raise ValueError("the fields stand on different nodes")
    return combine(left, right, sign)
