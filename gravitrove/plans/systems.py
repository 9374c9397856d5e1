"""Queries over normal equations, analysis and matrix filters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjustment, elimination, fields, filters, grids, synthesis
from . import relations as rel
from .queries import COEF, LEG, MAT, POINT, SERIES
from .registry import query, rounded

SMALL = f"{MAT}, a AS (SELECT i % 4 AS sys_id, i, j, v FROM f_mat WHERE j < 63), nn AS (SELECT x.sys_id, x.j AS i, y.j AS j, sum(x.v * y.v) + CASE WHEN x.j = y.j THEN 1e0 ELSE 0e0 END AS v FROM a x JOIN a y ON x.i = y.i GROUP BY 1, 2, 3), obs AS (SELECT i, v AS l FROM f_mat WHERE j = 63), rr AS (SELECT sys_id, j AS i, sum(v * l) AS rhs FROM a JOIN obs USING (i) GROUP BY 1, 2)"


def _systems(spark, sf):
    """Four systems of the matrix's columns but the last, which is observed, with one on the diagonal: 63 parameters each."""
    a = rel.matrix(spark, sf).withColumn("sys_id", (F.col("i") % 4).cast("int"))
    rows = a.groupBy("sys_id", "i").agg(F.filter(F.collect_list(F.struct("j", "v")), lambda x: x["j"] < 63).alias("row"), F.max(F.when(F.col("j") == 63, F.col("v"))).alias("l"))
    left = rows.select("sys_id", "l", "row", F.explode("row").alias("x"))
    products = left.select("sys_id", F.col("x.j").alias("i"), F.col("x.v").alias("u"), F.explode("row").alias("y"))
    normal = products.groupBy("sys_id", "i", F.col("y.j").alias("j")).agg(F.sum(F.col("u") * F.col("y.v")).alias("v"))
    normal = normal.withColumn("v", F.col("v") + (F.col("i") == F.col("j")).cast("double"))
    right = left.groupBy("sys_id", F.col("x.j").alias("i")).agg(F.sum(F.col("x.v") * F.col("l")).alias("rhs"))
    stats = rows.groupBy("sys_id").agg(F.sum(F.col("l") * F.col("l")).alias("lpl"), F.count("*").alias("obs"))
    return normal, right, stats


def _products(left, right, transpose=False):
    """Rows of left (or its transpose) times right, system by system."""
    row, column = ("j", "i") if transpose else ("i", "j")
    a = left.select("sys_id", F.col(row).alias("i"), F.col(column).alias("k"), F.col("v").alias("u"))
    return a.join(right.select("sys_id", F.col("i").alias("k"), "j", "v"), ["sys_id", "k"]).groupBy("sys_id", "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("v"))


@query(f"WITH {SMALL} SELECT CAST(sys_id AS INT) AS sys_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) AS v FROM nn")
def lsq03_cholesky_squared(spark, sf):
    factor = adjustment.cholesky(_systems(spark, sf)[0])
    return rounded(_products(factor, factor, True), v=6)


@query(f"WITH {SMALL} SELECT CAST(sys_id AS INT) AS sys_id, CAST(i AS BIGINT) AS i, round(rhs, 6) AS x FROM rr")
def lsq05_lsq08_solution_times_normals(spark, sf):
    normal, right, _ = _systems(spark, sf)
    return rounded(adjustment.multiply(normal, adjustment.solve(normal, right)).withColumn("i", F.col("i").cast("long")), x=6)


@query(f"WITH {SMALL} SELECT CAST(s AS INT) AS sys_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN i = j THEN 1e0 ELSE 0e0 END AS v FROM range(4) a(s), range(63) b(i), range(63) c(j)")
def lsq06_inverse_times_normals(spark, sf):
    normal = _systems(spark, sf)[0]
    product = _products(adjustment.inverse(normal), normal)
    return product.select("sys_id", "i", F.col("j").cast("long").alias("j"), (F.round("v", 8) + 0.0).alias("v"))


def _robust_sql(turns: int) -> str:
    """Down-weighted least squares of values on one and time, an iteration a pair of tables."""
    text = "d0 AS (SELECT event_id, mjd / 1e1 - 60324e-1 AS t, value AS y, 1e0 AS s FROM f_series)"
    for k in range(turns + 1):
        text += f""", n{k} AS (SELECT sum(1 / (s * s)) AS a, sum(t / (s * s)) AS b, sum(t * t / (s * s)) AS d, sum(y / (s * s)) AS e, sum(t * y / (s * s)) AS f, sum(y * y / (s * s)) AS g, count(*) AS n FROM d{k}),
x{k} AS (SELECT *, (d * e - b * f) / (a * d - b * b) AS x0, (a * f - b * e) / (a * d - b * b) AS x1 FROM n{k})"""
        if k < turns:
            size = "abs(y - x0 - x1 * t) / sqrt(r) / sqrt((g - e * x0 - f * x1) / (n - 2))"
            text += f""", r{k} AS (SELECT event_id, t, y, s, {size} AS z, r FROM (SELECT *, 1 - (d - 2 * t * b + t * t * a) / (a * d - b * b) / (s * s) AS r FROM d{k}, x{k}) q),
d{k + 1} AS (SELECT event_id, t, y, CASE WHEN z > 25e-1 AND r > 1e-4 THEN pow(z / 25e-1, 15e-1) ELSE s END AS s FROM r{k})"""
    return text


@query(f"WITH {SERIES}, {_robust_sql(2)} SELECT event_id, round(x0 + x1 * t, 6) AS fitted, round(s, 6) AS sigma FROM d2, x2")
def lsq13_robust_line(spark, sf):
    """A line through all values, with outliers weighed down twice over: the fit and the sigma of each."""
    rows = rel.series(spark, sf).select("event_id", F.lit(1.0).alias("one"), (F.col("mjd") / 10 - 6032.4).alias("t"), F.col("value").alias("y"))
    x, _, weighed = adjustment.robust(rows, ["one", "t"], "y", iterations=2)
    return weighed.select("event_id", F.round(x[0] + x[1] * F.col("t"), 6).alias("fitted"), F.round("sigma", 6).alias("sigma"))


BAND = f"{MAT}, nn AS (SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM f_mat x JOIN f_mat y ON x.i = y.i AND y.j - x.j BETWEEN 0 AND 1 GROUP BY 1, 2), line AS (SELECT a.i AS k, a.v AS a, coalesce(b.v * 4e-1, 0e0) AS b FROM nn a LEFT JOIN nn b ON b.i = a.i AND b.j = a.i + 1 WHERE a.i = a.j)"


@query(f"""WITH RECURSIVE {BAND}, down(k, d) AS (SELECT k, a FROM line WHERE k = 0 UNION ALL SELECT l.k, l.a - p.b * p.b / d FROM down JOIN line p ON p.k = down.k JOIN line l ON l.k = down.k + 1),
up(k, e) AS (SELECT k, a FROM line WHERE k = 63 UNION ALL SELECT l.k, l.a - l.b * l.b / e FROM up JOIN line l ON l.k = up.k - 1),
diag AS (SELECT k, d, b, 1 / (d + e - a) AS z FROM line JOIN down USING (k) JOIN up USING (k)), beside AS (SELECT x.k, -x.b / x.d * y.z AS z FROM diag x JOIN diag y ON y.k = x.k + 1)
SELECT CAST(k AS BIGINT) AS i, CAST(k AS BIGINT) AS j, round(z, 10) AS v FROM diag UNION ALL SELECT CAST(k AS BIGINT), CAST(k + 1 AS BIGINT), round(z, 10) FROM beside UNION ALL SELECT CAST(k + 1 AS BIGINT), CAST(k AS BIGINT), round(z, 10) FROM beside""")
def lsq01_lsq06_inverse_on_a_band(spark, sf):
    """The normal matrix's diagonal and, at two fifths, what is next to it: its inverse there, by blocks of sixteen."""
    a = rel.matrix(spark, sf).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("row"))
    pairs = F.explode(F.flatten(F.transform(F.map_keys("row"), lambda j: F.transform(F.sequence(j, j + 1), lambda k: F.struct(j.alias("i"), k.alias("j"))))))
    upper = a.select("row", pairs.alias("p")).where("row[p.j] is not null").groupBy("p.i", "p.j").agg(F.sum(F.col("row")[F.col("p.i")] * F.col("row")[F.col("p.j")]).alias("v"))
    upper = upper.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.4 * F.col("v")).alias("v"))
    band = upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return rounded(elimination.sparse_inverse_entries(band, 16), v=10)


@query(f"WITH {SMALL} SELECT CAST(sys_id AS INT) AS sys_id, CAST(i AS BIGINT) AS i, round(sum(v * (j + 1e0)), 6) AS x FROM nn GROUP BY 1, 2")
def lsq04_symmetric_product(spark, sf):
    normal = _systems(spark, sf)[0]
    upper = normal.where("i <= j")
    vector = normal.select("sys_id", "i").distinct().withColumn("x", F.col("i") + 1.0)
    return rounded(adjustment.multiply(adjustment.symmetric(upper), vector).withColumn("i", F.col("i").cast("long")), x=6)


@query(f"WITH {SMALL}, x AS (SELECT sys_id, i, 1e-2 * (i + 1) AS x FROM rr), nx AS (SELECT n.sys_id, n.i, sum(v * x) AS nx FROM nn n JOIN x ON x.sys_id = n.sys_id AND x.i = n.j GROUP BY 1, 2), t AS (SELECT i % 4 AS sys_id, sum(l * l) AS lpl, count(*) AS obs FROM obs GROUP BY 1), e AS (SELECT sys_id, any_value(lpl) + sum(x * nx) - 2 * sum(x * rhs) AS epe, any_value(obs) AS obs FROM x JOIN nx USING (sys_id, i) JOIN rr USING (sys_id, i) JOIN t USING (sys_id) GROUP BY 1) SELECT CAST(sys_id AS INT) AS sys_id, round(epe, 6) AS epe, round(sqrt(epe / (obs - 63)), 6) AS sigma FROM e")
def lsq09_residuals_and_sigma(spark, sf):
    normal, right, stats = _systems(spark, sf)
    x = right.select("sys_id", "i", ((F.col("i") + 1) * 1e-2).alias("x"))
    epe = adjustment.residual_square_sums(normal, right, stats, x)
    return rounded(epe.join(adjustment.posterior_sigmas(normal, right, stats, x), "sys_id"), epe=6, sigma=6)


@query(f"WITH {SMALL} SELECT CAST(sys_id AS INT) AS sys_id, round(2 * (count(*) - 63e0 / 4), 6) AS redundancy FROM (SELECT i % 4 AS sys_id FROM obs) o GROUP BY 1")
def lsq09_redundancy(spark, sf):
    """With each system as the combined one, and a variance of 4, the trace is the number of parameters."""
    normal, _, stats = _systems(spark, sf)
    factors = stats.select("sys_id", F.lit(4.0).alias("factor"))
    parts = None
    for k in range(4):
        mine = normal.where(F.col("sys_id") == k)
        part = adjustment.redundancies(mine, stats.where(F.col("sys_id") == k), adjustment.inverse(mine).select("i", "j", "v"), factors)
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("sys_id", F.round(2 * F.col("redundancy"), 6).alias("redundancy"))


@query("SELECT CAST(s AS INT) AS sys_id, CAST(k AS BIGINT) AS i, k + 1e0 AS w, round((k + 1e0) * k / 10e0, 8) AS rhs FROM range(4) a(s), range(63) b(k)")
def lsq10_tikhonov(spark, sf):
    parameters = _systems(spark, sf)[1].select("sys_id", F.col("i").cast("long").alias("i"))
    matrix, right, _ = adjustment.tikhonov(parameters.withColumn("w", F.col("i") + 1.0), parameters.withColumn("x", F.col("i") / 10.0))
    return matrix.join(right, ["sys_id", "i"]).select("sys_id", "i", F.col("v").alias("w"), F.round("rhs", 8).alias("rhs"))


@query(f"WITH {SMALL} SELECT CAST(sys_id AS INT) AS sys_id, round(sum(v), 5) AS trace, round(sum(v), 5) AS total FROM nn WHERE i = j GROUP BY 1")
def sort07_eigenvalues(spark, sf):
    """The sum of all eigenvalues is the trace."""
    normal = _systems(spark, sf)[0]
    pairs = adjustment.top_eigenpairs(normal, 63).groupBy("sys_id", "rank").agg(F.first("eigenvalue").alias("e")).groupBy("sys_id").agg(F.round(F.sum("e"), 5).alias("total"))
    return normal.where("i = j").groupBy("sys_id").agg(F.round(F.sum("v"), 5).alias("trace")).join(pairs, "sys_id")


@query(f"WITH {SMALL} SELECT CAST(sys_id AS INT) AS sys_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 5) AS v FROM nn")
def lsq16_sigma_points(spark, sf):
    """The covariance of the points drawn from a covariance is that covariance."""
    normal, right, _ = _systems(spark, sf)
    points = adjustment.sigma_points(right.select("sys_id", F.col("i").cast("long").alias("i"), F.col("rhs").alias("x")), normal, 0.25)
    return rounded(adjustment.moments_of_points(points)[1], v=5)


@query()
def lsq12_variance_components(spark, sf):
    normal, right, stats = _systems(spark, sf)
    return adjustment.variance_components(normal, right, stats, 3)[1]


@query(f"WITH {COEF}, e AS (SELECT DISTINCT epoch FROM f_coef), k AS (SELECT DISTINCT n, m, trig FROM f_coef) SELECT epoch, n, m, trig, round(coalesce(value, 0e0), 10) AS value FROM e CROSS JOIN k LEFT JOIN f_coef USING (epoch, n, m, trig)")
def syn05_syn06_analysis_of_synthesis(spark, sf):
    """A coefficient that a month lacks counts as 0 and comes back as such."""
    grid = grids.gauss_grid(spark, 10)
    field = rel.coefficients(spark, sf)
    found = synthesis.analyse(synthesis.synthesise_grid(field, grid, 8), grid, 8)
    return found.withColumn("value", F.round("value", 10) + 0.0)


@query(f"WITH RECURSIVE {POINT}, {LEG} SELECT point_id, n, m, k AS trig, round(p * CASE WHEN k = 0 THEN cos(m * lon) ELSE sin(m * lon) END, 9) + 0e0 AS v FROM f_leg JOIN f_point USING (point_id), (VALUES (0), (1)) t(k) WHERE NOT (m = 0 AND k = 1)")
def fn06_syn03_synthesis_matrix(spark, sf):
    return rounded(synthesis.basis_matrix(rel.points(spark, sf), 8), v=9)


@query(f"WITH RECURSIVE {POINT}, {LEG} SELECT point_id, round(sqrt(sum(p * p / (n + 1e0))), 8) AS sigma FROM f_leg GROUP BY 1")
def syn08_propagated_variances(spark, sf):
    field = rel.coefficients(spark, sf).select("n", "m", "trig").distinct()
    covariance = field.select("*", F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("trig").alias("trig2"), (1.0 / (F.col("n") + 1)).alias("v"))
    return rounded(synthesis.propagate(covariance, rel.points(spark, sf), 8), sigma=8)


@query(f"WITH {POINT}, q AS (SELECT point_id, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM f_point) SELECT DATE '2000-01-01' AS epoch, point_id, round(-x * f + u * x * (5 * z * z - 1), 6) AS gx, round(-y * f + u * y * (5 * z * z - 1), 6) AS gy, round(-z * f + u * z * (5 * z * z - 3), 6) AS gz FROM q, (SELECT 3.986004415e14 / (7e6 * 7e6) AS f, 3.986004415e14 / (7e6 * 7e6) * pow(6378136.3 / 7e6, 2) * 15e-1 * 108263e-8 AS u) c")
def syn02_acceleration(spark, sf):
    """Central term and oblateness, whose closed formula is the oracle."""
    field = spark.createDataFrame([(0, 0, 0, 1.0), (2, 0, 0, -108263e-8 / 5**0.5)], "n int, m int, trig int, value double").withColumn("epoch", F.lit("2000-01-01").cast("date"))
    lat, lon = F.col("lat"), F.col("lon")
    points = rel.points(spark, sf).select("point_id", (7e6 * F.cos(lat) * F.cos(lon)).alias("x"), (7e6 * F.cos(lat) * F.sin(lon)).alias("y"), (7e6 * F.sin(lat)).alias("z"))
    return rounded(synthesis.acceleration(field, points, 2), gx=6, gy=6, gz=6)


def _blocks(spark):
    """Normal matrices of every order, degrees up to 8: 1e16 on the diagonal, falling off with the difference of degrees."""
    pairs = [(m, t, i, j, 1e16 / (1 + abs(i - j)) ** 2) for m in range(9) for t in (0, 1) if m or not t for i in range(m, 9) for j in range(m, 9)]
    return spark.createDataFrame(pairs, "m int, trig int, i int, j int, v double")


BLOCK = "d AS (SELECT CAST(k AS INT) AS k FROM range(9) t(k)), b AS (SELECT m.k AS m, t.k AS trig, i.k AS i, j.k AS j, 1e16 / pow(1e0 + abs(i.k - j.k), 2) AS v FROM d m, d t, d i, d j WHERE t.k <= 1 AND (m.k > 0 OR t.k = 0) AND i.k >= m.k AND j.k >= m.k)"


@query(f"WITH {BLOCK} SELECT m, trig, i, j, round(v / 1e12, 4) AS v FROM b")
def fil05_fil06_filter_times_regularised(spark, sf):
    """(N + W) times the filter is N."""
    normal = _blocks(spark)
    weight = F.when(F.col("i") == F.col("k"), F.when(F.col("i") == 0, 1.0).otherwise(1e12 * F.pow("i", F.lit(4.0)))).otherwise(0.0)
    left = normal.select("m", "trig", "i", F.col("j").alias("k"), F.col("v").alias("u")).withColumn("u", F.col("u") + weight)
    right = filters.ddk(normal, 3).withColumnRenamed("i", "k")
    product = left.join(right, ["m", "trig", "k"]).groupBy("m", "trig", "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("v"))
    return product.select("m", "trig", "i", "j", F.round(F.col("v") / 1e12, 4).alias("v"))


@query(f"WITH {COEF}, {BLOCK} SELECT epoch, n, m, trig, round(value, 12) AS value FROM f_coef WHERE n < 2 UNION ALL SELECT epoch, b.i, b.m, b.trig, round(sum(v / 1e16 * value), 12) FROM f_coef f JOIN b ON b.m = f.m AND b.trig = f.trig AND b.j = f.n WHERE b.i >= 2 GROUP BY 1, 2, 3, 4")
def fil04_order_wise(spark, sf):
    blocks = _blocks(spark).withColumn("v", F.col("v") / 1e16)
    return rounded(filters.order_wise(rel.coefficients(spark, sf), blocks), value=12)


@query(f"WITH {COEF} SELECT epoch, n, m, trig, round(value / (1 + 1e-2 * pow(n, 2e0)), 12) AS value FROM f_coef")
def fil07_fil08_fil09_regularised(spark, sf):
    """A diagonal normal matrix makes the filter a factor of each degree."""
    keys = [(n, m, t) for n in range(9) for m in range(n + 1) for t in (0, 1) if m or not t]
    unit = spark.createDataFrame([(*k, *k, 100.0) for k in keys], "i_n int, i_m int, i_trig int, n int, m int, trig int, v double")
    return rounded(fields.matrix_filter(rel.coefficients(spark, sf), filters.regularised(unit, 1.0, 2.0)), value=12)


@query("SELECT a.n AS i_n, a.m AS i_m, a.t AS i_trig, b.n, b.m, b.t AS trig, CASE WHEN a.n = b.n AND a.m = b.m AND a.t = b.t THEN 2e0 ELSE 0e0 END AS v FROM (SELECT CAST(x.k AS INT) AS n, CAST(y.k AS INT) AS m, CAST(z.k AS INT) AS t FROM range(5) x(k), range(5) y(k), range(2) z(k) WHERE y.k <= x.k AND (y.k > 0 OR z.k = 0)) a, (SELECT CAST(x.k AS INT) AS n, CAST(y.k AS INT) AS m, CAST(z.k AS INT) AS t FROM range(5) x(k), range(5) y(k), range(2) z(k) WHERE y.k <= x.k AND (y.k > 0 OR z.k = 0)) b")
def syn07_window_matrix(spark, sf):
    """A constant window is that constant times the unit matrix."""
    window = synthesis.window_matrix(grids.gauss_grid(spark, 6).withColumn("value", F.lit(2.0)), 4)
    return window.withColumn("v", F.round("v", 9) + 0.0)


@query(f"WITH {COEF}, e AS (SELECT DISTINCT epoch FROM f_coef), k AS (SELECT CAST(x AS INT) AS idx, CAST(floor(sqrt(x + 4)) AS INT) AS n FROM range(96) t(x)), i AS (SELECT idx, n, idx + 4 - n * n AS rem FROM k) SELECT e.epoch, i.idx, round(coalesce(value, 0e0), 12) AS value FROM e CROSS JOIN i LEFT JOIN f_coef f ON f.epoch = e.epoch AND f.n = i.n AND n * n + CASE WHEN m = 0 THEN 0 ELSE 2 * m - 1 + trig END - 4 = i.idx".replace("AND n * n +", "AND f.n * f.n +"))
def fn07_ravel(spark, sf):
    return rounded(fields.raveled(rel.coefficients(spark, sf), 2, 9), value=12)


@query(f"WITH {COEF} SELECT epoch, n, m, trig, round(value, 12) AS value FROM f_coef WHERE value <> 0")
def fn08_unravel(spark, sf):
    return rounded(fields.unraveled(fields.raveled(rel.coefficients(spark, sf), 0, 8)).where("value != 0"), value=12)


@query(f"WITH {COEF} SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY n, m, trig) - 1 AS INT) AS source_idx, CAST(row_number() OVER (PARTITION BY epoch ORDER BY m, n, trig) - 1 AS INT) AS target_idx FROM f_coef")
def join13_sort03_sort04_reorder(spark, sf):
    return fields.reorder_indices(rel.coefficients(spark, sf), "degree", "order_alternating")


@query(f"WITH {COEF} SELECT epoch, n, m, trig, round(value * 75e-2, 12) AS value FROM f_coef")
def join03_series_difference(spark, sf):
    field = rel.coefficients(spark, sf)
    return rounded(fields.combine_series(field, fields.scale(field, 0.25), -1), value=12)


@query(f"WITH {COEF}, d AS (SELECT n, sqrt(sum(value * value)) AS value FROM f_coef WHERE n > 0 GROUP BY 1) SELECT round(exp(regr_intercept(2 * ln(value), ln(n)) / 2), 9) AS factor, round(-regr_slope(2 * ln(value), ln(n)), 8) AS power FROM d")
def fn23_power_law(spark, sf):
    degrees = rel.coefficients(spark, sf).groupBy("n").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
    return rounded(fields.power_law(degrees), factor=9, power=8)


@query(f"WITH {SMALL} SELECT CAST(sys_id AS INT) AS sys_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(4 * v, 4) AS v FROM nn")
def lsq17_unscented_transform(spark, sf):
    """A linear change of the points changes the covariance by its square."""
    normal, right, _ = _systems(spark, sf)
    mean = right.select("sys_id", F.col("i").cast("long").alias("i"), F.col("rhs").alias("x"))
    double = lambda points: points.withColumn("x", 2 * F.col("x") + 1)
    return rounded(adjustment.unscented(mean, normal, double, alpha=0.5)[1], v=4)
