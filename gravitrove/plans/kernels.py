"""Queries over full matrices of harmonics out of the embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anisotropic, grids, synthesis
from . import relations as rel
from .queries import LEG, MAT, POINT
from .registry import query, rounded

#: The embeddings' mean products as a matrix of harmonics of degrees 0 to 7; u0 and u1 are the places of numbers degree by degree.
FULL = f"""{MAT}, kk AS (SELECT x.j AS i, y.j AS j, sum(x.v * y.v) / (SELECT count(DISTINCT i) FROM f_mat) AS v FROM f_mat x JOIN f_mat y ON x.i = y.i GROUP BY 1, 2)"""
MESH = "f_point AS (SELECT CAST(k AS BIGINT) AS point_id, radians(-165e0 + 30 * (k % 12)) AS lon, radians(75e0 - 30 * (k // 12)) AS lat, 0e0 AS value FROM range(72) t(k))"


def _basis(name: str, leg: str, points: str) -> str:
    both = f"SELECT point_id, n * n + CASE WHEN m = 0 THEN 0 ELSE 2 * m - 1 END AS i, p * cos(m * lon) AS f FROM {leg} JOIN {points} USING (point_id) WHERE n < 8 UNION ALL SELECT point_id, n * n + 2 * m, p * sin(m * lon) FROM {leg} JOIN {points} USING (point_id) WHERE n < 8 AND m > 0"
    return f"{name} AS ({both})"


def _other(text: str) -> str:
    """The same recursion over the mesh, under other names."""
    for name in ("f_point", "pts", "sect", "rec", "f_leg"):
        text = text.replace(name, f"g_{name}")
    return text


def _matrix(spark, sf):
    a = rel.matrix(spark, sf)
    count = a.select("i").distinct().count()
    rows = a.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("row"))
    pairs = rows.select("row", F.explode("row").alias("x")).select("x.*", F.explode("row").alias("y"))
    sums = pairs.groupBy("j", F.col("y.j").alias("j2")).agg((F.sum(F.col("v") * F.col("y.v")) / count).alias("v"))
    one = rel.unpacked(sums, "j").select("n", "m", "trig", "j2", "v")
    return rel.unpacked(one.withColumnsRenamed({"n": "a", "m": "b", "trig": "c"}), "j2").select(F.col("a").alias("n"), F.col("b").alias("m"), F.col("c").alias("trig"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("trig").alias("trig2"), "v")


def _mesh(spark):
    return grids.geographic_grid(spark, 30.0, 30.0)


@query(f"WITH RECURSIVE {FULL}, {POINT}, {LEG}, {_basis('src', 'f_leg', 'f_point')}, {_other(MESH)}, {_other(LEG)}, {_basis('ev', 'g_f_leg', 'g_f_point')}, half AS (SELECT point_id AS source_id, j, sum(f * v) AS h FROM src JOIN kk USING (i) GROUP BY 1, 2) SELECT source_id, point_id, round(sum(h * f), 8) AS value FROM half JOIN ev ON ev.i = half.j GROUP BY 1, 2")
def ker19_kernel_of_a_full_matrix(spark, sf):
    """The kernel about every supplier on a mesh."""
    return rounded(anisotropic.kernel_values(_matrix(spark, sf), rel.points(spark, sf), _mesh(spark), 7, on_parallels=True), value=8)


@query(f"WITH RECURSIVE {FULL}, {POINT}, {LEG}, {_basis('src', 'f_leg', 'f_point')}, {_other(MESH)}, {_other(LEG)}, {_basis('ev', 'g_f_leg', 'g_f_point')}, sums AS (SELECT i, sum(f * value) AS c FROM src JOIN f_point USING (point_id) GROUP BY 1), field AS (SELECT kk.i, sum(v * c) AS c FROM kk JOIN sums ON sums.i = kk.j GROUP BY 1) SELECT point_id, round(sum(c * f), 3) AS value FROM ev JOIN field USING (i) GROUP BY 1")
def syn10_anisotropic_basis_functions(spark, sf):
    """The suppliers' values as weights of the kernel about each."""
    points = rel.points(spark, sf)
    values = points.select(F.lit(0).alias("epoch"), "point_id", "value")
    return rounded(anisotropic.to_grid(values, points, _matrix(spark, sf), _mesh(spark), 7).select("point_id", "value"), value=3)


@query(f"WITH RECURSIVE {FULL}, {MESH}, {LEG}, {_basis('ev', 'f_leg', 'f_point')}, half AS (SELECT point_id, j, sum(f * v) AS h FROM ev JOIN kk USING (i) GROUP BY 1, 2) SELECT h.point_id, round(sqrt(sum(h * f)), 8) AS sigma FROM half h JOIN ev ON ev.point_id = h.point_id AND ev.i = h.j GROUP BY 1")
def syn08_full_covariance_on_a_grid(spark, sf):
    return rounded(synthesis.propagate_grid(_matrix(spark, sf), _mesh(spark), 7), sigma=8)
