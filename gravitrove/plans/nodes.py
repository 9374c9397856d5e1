"""Queries over node values, scattered analysis, kernels on the sphere and singular values, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import harmonics
from ..operators import fields, grids, matrices, nodes, series, synthesis
from . import relations as rel
from .queries import COEF, LEG, MAT, POINT
from .registry import query, rounded

#: A kernel of degrees 0 to 3, and its value at distance x by closed Legendre polynomials.
KERNEL = (1.0, 0.8, 0.5, 0.2)
VALUE = "(1e0 + 24e-1 * cos(x) + 25e-1 * (3 * cos(x) * cos(x) - 1) / 2 + 14e-1 * (5 * pow(cos(x), 3) - 3 * cos(x)) / 2)"


def _at(x: str) -> str:
    return VALUE.replace("(x)", f"({x})")


def _shape(spark, max_degree):
    return fields.all_coefficients(spark, max_degree).select("n", "m", "trig", (1.0 / (F.col("n") + 1)).alias("k"))


@query(f"WITH RECURSIVE {POINT}, {LEG} SELECT DATE '2000-01-01' AS epoch, n, m, k AS trig, round(sum(value * p * CASE WHEN k = 0 THEN cos(m * lon) ELSE sin(m * lon) END / (n + 1e0)), 5) AS value FROM f_leg JOIN f_point USING (point_id), (VALUES (0), (1)) t(k) WHERE NOT (m = 0 AND k = 1) GROUP BY 1, 2, 3, 4")
def syn09_basis_functions(spark, sf):
    points = rel.points(spark, sf)
    values = points.select(F.lit("2000-01-01").cast("date").alias("epoch"), "point_id", "value")
    return rounded(nodes.to_coefficients(values, points, _shape(spark, 8), 8), value=5)


@query(f"WITH {POINT} SELECT DATE '2000-01-01' AS epoch, point_id, round(value / 2, 6) AS value FROM f_point")
def prj12_join02_mascon_difference(spark, sf):
    points = rel.points(spark, sf)
    values = points.select(F.lit("2000-01-01").cast("date").alias("epoch"), "point_id", "value")
    return rounded(nodes.combined_on_same_nodes(values, values.withColumn("value", F.col("value") / 2), points, points, -1), value=6)


@query(f"WITH {COEF} SELECT epoch, n, " + ", ".join(f"round(max(CASE WHEN m = {m} AND trig = {t} AND n >= 2 THEN value END), 12) AS {'s' if t else 'c'}{m}" for m, t in [(m, 1) for m in range(4, 0, -1)] + [(m, 0) for m in range(5)]) + " FROM f_coef WHERE n <= 4 GROUP BY 1, 2")
def prj08_triangle(spark, sf):
    found = fields.coefficient_triangle(rel.coefficients(spark, sf), 4)
    return rounded(found, **{c: 12 for c in found.columns if c not in ("epoch", "n")})


@query(f"WITH {COEF}, e AS (SELECT DISTINCT epoch FROM f_coef), k AS (SELECT DISTINCT n, m, trig FROM f_coef) SELECT epoch, n, m, trig, round(coalesce(value, 0e0), 9) AS value FROM e CROSS JOIN k LEFT JOIN f_coef USING (epoch, n, m, trig)")
def syn04_scattered_analysis(spark, sf):
    """Values of the whole field at a spiral's points give that field back."""
    field = rel.coefficients(spark, sf)
    points = grids.spiral_grid(spark, 1.5e6, "geocentric", f=0.0)
    found = synthesis.analyse_scattered(synthesis.synthesise(field, points, 8), points, 8)
    return found.withColumn("value", F.round("value", 9) + 0.0)


@query(f"WITH s AS (SELECT CAST(k AS INT) AS k, k * {math.pi / 99!r} AS psi FROM range(100) t(k)), peak AS (SELECT s.k, max({_at('j.psi')} + {_at('abs(s.psi - j.psi)')}) AS peak FROM s, s j GROUP BY 1) SELECT s.k, round(psi, 9) AS psi, round(greatest(0, 1 - 2 * {_at('psi / 2')} / peak), 7) + 0e0 AS mtf FROM s JOIN peak USING (k)")
def ker07_modulation_transfer(spark, sf):
    found = harmonics.modulation_transfer(spark, list(KERNEL))
    return found.select("k", F.round("psi", 9).alias("psi"), (F.round("mtf", 7) + 0.0).alias("mtf"))


@query(f"WITH s AS (SELECT k * {math.pi / 2e5!r} AS psi FROM range(1, 100000) t(k)), v AS (SELECT psi, ({_at('psi + 1e-4')} - 2 * {_at('psi')} + {_at('psi - 1e-4')}) AS bend FROM s) SELECT round(2 * 6378136.3 * min(psi) / 1e4) AS resolution FROM v WHERE bend >= 0")
def ker08_spatial_resolution(spark, sf):
    return harmonics.spatial_resolution(spark, list(KERNEL)).select(F.round(F.col("resolution") / 1e4).alias("resolution"))


@query(f"WITH {COEF}, k AS (SELECT n, m, trig, value, CAST(epoch - DATE '1858-11-17' AS DOUBLE) AS mjd FROM f_coef), b AS (SELECT n, m, trig, max(CASE WHEN mjd <= 51000 THEN mjd END) AS t0, min(CASE WHEN mjd >= 51000 THEN mjd END) AS t1 FROM k GROUP BY 1, 2, 3) SELECT b.n, b.m, b.trig, round(CASE WHEN t0 = t1 THEN x.value ELSE x.value + (y.value - x.value) * (51000 - t0) / (t1 - t0) END, 12) AS value FROM b JOIN k x ON x.n = b.n AND x.m = b.m AND x.trig = b.trig AND x.mjd = t0 JOIN k y ON y.n = b.n AND y.m = b.m AND y.trig = b.trig AND y.mjd = t1")
def join15_evaluate_at(spark, sf):
    """Every coefficient of the monthly fields at one moment."""
    field = rel.coefficients(spark, sf).select(F.struct("n", "m", "trig").alias("key"), F.datediff("epoch", F.lit("1858-11-17").cast("date")).cast("double").alias("mjd"), "value")
    return rounded(series.evaluate_at(field, 51000.0, "key").select("key.*", "value"), value=12)


@query(f"WITH {MAT} SELECT i, j, round(v, 6) + 0e0 AS v FROM f_mat")
def sort08_singular_values(spark, sf):
    """With all singular values the three factors multiply to the matrix."""
    values, right, left = matrices.truncated_svd(rel.matrix(spark, sf), 64)
    product = left.join(values, "rank").join(right, "rank").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("sigma") * F.col("v")).alias("v"))
    return product.select("i", F.col("j").cast("int").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {MAT}, nn AS (SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM f_mat x JOIN f_mat y ON x.i = y.i GROUP BY 1, 2), n2 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM nn x JOIN nn y ON x.j = y.i GROUP BY 1, 2) SELECT 2 AS power, round(sum(v), 6) AS total FROM nn WHERE i = j UNION ALL SELECT 4, round(sum(v * v), 4) FROM nn UNION ALL SELECT 6, round(sum(nn.v * n2.v), 2) FROM nn JOIN n2 USING (i, j) UNION ALL SELECT 8, round(sum(v * v) / 1e3, 2) FROM n2")
def sort08_powers_of_singular_values(spark, sf):
    """Sums of powers of the singular values, which are traces of powers of A'A."""
    values = matrices.truncated_svd(rel.matrix(spark, sf), 64)[0].select((F.col("sigma") * F.col("sigma")).alias("s"))
    totals = values.select(F.explode(F.array(*[F.struct(F.lit(k).alias("power"), F.pow("s", F.lit(k / 2)).alias("t")) for k in (2, 4, 6, 8)])).alias("x")).groupBy("x.power").agg(F.sum("x.t").alias("t"))
    scaled = F.when(F.col("power") == 8, F.col("t") / 1e3).otherwise(F.col("t"))
    digits = {2: 6, 4: 4, 6: 2, 8: 2}
    return totals.select("power", F.coalesce(*[F.when(F.col("power") == k, F.round(scaled, d)) for k, d in digits.items()]).alias("total"))


@query(f"WITH RECURSIVE {POINT}, {LEG} SELECT point_id, n, m, round(p, 9) AS p FROM f_leg WHERE m = 3")
def fn02_one_order(spark, sf):
    points = rel.points(spark, sf).withColumn("colat", F.lit(math.pi / 2) - F.col("lat"))
    return rounded(harmonics.legendre_of_order(points, 8, 3), p=9)


@query("SELECT 1e0 AS arcs, 12.566370614 AS area, true AS poles")
def gen09_spiral(spark, sf):
    """Steps along the spiral are equal to their mean, areas make up the sphere, and both poles are points."""
    points = grids.spiral_grid(spark, 1e6, "geocentric", f=0.0)
    later = points.select((F.col("point_id") - 1).alias("point_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    chords = points.join(later, "point_id").where("abs(lat) < 0.8 and abs(lat2) < 0.8").select(F.sqrt(2 - 2 * (F.sin("lat") * F.sin("lat2") + F.cos("lat") * F.cos("lat2") * F.cos(F.col("lon2") - F.col("lon")))).alias("d"))
    even = chords.agg(F.round(F.max("d") / F.min("d"), 1).alias("arcs"))
    whole = points.agg(F.round(F.sum("area"), 9).alias("area"), (F.max("lat") > 1.5707).alias("north"), (F.min("lat") < -1.5707).alias("south"))
    return even.join(whole, F.lit(True)).select("arcs", "area", (F.col("north") & F.col("south")).alias("poles"))
