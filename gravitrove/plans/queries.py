"""Queries over the derived relations and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy, time
from ..operators import fields, grids, matrices, series, synthesis
from . import relations as rel
from .registry import query, rounded

COEF = """f_coef AS (SELECT epoch, n, CAST(floor((rem + 1) / 2e0) AS INT) AS m, CAST(CASE WHEN rem = 0 THEN 0 ELSE (rem + 1) % 2 END AS INT) AS trig, avg(v) * 1.0471975512e-9 AS value
  FROM (SELECT epoch, n, idx - n * n AS rem, v FROM (SELECT epoch, idx, CAST(floor(sqrt(idx)) AS INT) AS n, v FROM (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS epoch, CAST((l_orderkey * 7 + l_linenumber * 13) % 81 AS INT) AS idx, l_extendedprice AS v FROM lineitem) a) b) c GROUP BY 1, 2, 3, 4)"""
POINT = """f_point AS (SELECT CAST(s_suppkey AS BIGINT) AS point_id, radians((s_suppkey * 1.3750776405e2) % 360 - 180) AS lon, asin(2e0 * ((s_suppkey * 6.180339887e-1) % 1) - 1e0) AS lat, s_acctbal AS value FROM supplier)"""
OTHER = POINT.replace("f_point", "f_other").replace("s_suppkey", "c_custkey").replace("s_acctbal", "c_acctbal").replace("supplier", "customer")

LEG = """pts AS (SELECT point_id, sin(lat) AS t, cos(lat) AS u FROM f_point),
sect(point_id, m, p, t, u) AS (SELECT point_id, 0, 1e0, t, u FROM pts UNION ALL
  SELECT point_id, m + 1, p * u * (CASE WHEN m = 0 THEN sqrt(3e0) ELSE sqrt((2e0 * m + 3e0) / (2e0 * m + 2e0)) END), t, u FROM sect WHERE m < 8),
rec(point_id, m, n, p, pprev, t) AS (SELECT point_id, m, m, p, 0e0, t FROM sect UNION ALL
  SELECT point_id, m, n + 1, sqrt((2e0 * n + 1e0) / (n + 1e0 - m) * (2e0 * n + 3e0) / (n + 1e0 + m)) * t * p
    - (CASE WHEN n = m THEN 0e0 ELSE sqrt((2e0 * n + 3e0) / (2e0 * n - 1e0) * (n - m) / (n + 1e0 - m) * (n + m) / (n + 1e0 + m)) END) * pprev, p, t FROM rec WHERE n < 8),
f_leg AS (SELECT point_id, n, m, p FROM rec)"""
SERIES = """f_series AS (SELECT event_id, event_type, user_id, 60309e0 + extract(day FROM ts) + (extract(hour FROM ts) * 3600e0 + extract(minute FROM ts) * 60e0 + floor(CAST(extract(second FROM ts) AS DOUBLE))) / 86400e0 AS mjd, value FROM events)"""
SYNTH = "f_synth AS (SELECT c.epoch, q.point_id, sum(l.p * c.value * (CASE WHEN c.trig = 0 THEN cos(c.m * q.lon) ELSE sin(c.m * q.lon) END)) AS value FROM f_coef c JOIN f_leg l ON l.n = c.n AND l.m = c.m JOIN f_point q ON q.point_id = l.point_id GROUP BY 1, 2)"
MAT = "f_mat AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
BASIN = """corner AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) v(seq, dx, dy)),
box AS (SELECT r_regionkey AS basin_id, radians(-171e0 + 72e0 * r_regionkey) AS x0, radians(-171e0 + 72e0 * r_regionkey + 54e0) AS x1, radians(-30e0) AS y0, radians(30e0) AS y1 FROM region)"""

@query(f"WITH {COEF} SELECT epoch, n, m, trig, round(value, 12) AS value FROM f_coef WHERE n BETWEEN 2 AND 6 AND (n - 2) % 2 = 0 AND m <= 4")
def prj04_band(spark, sf):
    return rounded(fields.band(rel.coefficients(spark, sf), 2, 6, 0, 4, step_degree=2), value=12)


@query(f"WITH {COEF} SELECT epoch, n, m, trig, round(value * 25e-1, 12) AS value FROM f_coef WHERE n <= 4")
def prj06_truncate_scaled(spark, sf):
    return rounded(fields.scale(fields.truncate(rel.coefficients(spark, sf), 4), 2.5), value=12)


@query(f"WITH {COEF}, g AS (SELECT epoch, n, m, max(CASE WHEN trig = 0 THEN value ELSE 0 END) AS c, max(CASE WHEN trig = 1 THEN value ELSE 0 END) AS s FROM f_coef GROUP BY 1, 2, 3) SELECT epoch, n, m, round(sqrt(c * c + s * s), 12) AS amplitude, round(CASE WHEN m = 0 THEN 0 ELSE atan2(s, c) END, 9) AS phase FROM g")
def prj09_agg05_amplitude_and_phase(spark, sf):
    return rounded(fields.coefficient_amplitudes(rel.coefficients(spark, sf)), amplitude=12, phase=9)


@query(f"WITH {COEF} SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY m, trig, n) - 1 AS INT) AS idx, n, m, trig, round(value, 12) AS value FROM f_coef")
def sort05_order_wise(spark, sf):
    return rounded(fields.ordered(rel.coefficients(spark, sf), "order"), value=12)


@query(f"WITH {COEF} SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY CASE WHEN trig = 0 THEN n ELSE m - 1 END, CASE WHEN trig = 0 THEN m ELSE n END) - 1 AS INT) AS idx, n, m, trig, round(value, 12) AS value FROM f_coef")
def sort06_flat_array(spark, sf):
    return rounded(fields.ordered(rel.coefficients(spark, sf), "flat"), value=12)


@query(f"WITH {COEF}, b AS (SELECT epoch, n, m, trig, value * 11e-1 * pow(9e-1, n) AS value FROM f_coef WHERE n <= 5) SELECT epoch, n, m, trig, round(sum(value), 12) AS value FROM (SELECT epoch, n, m, trig, value FROM f_coef UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3, 4")
def join01_add_rescaled(spark, sf):
    field = rel.coefficients(spark, sf)
    return rounded(fields.combine(field, fields.truncate(field, 5), 1, 0.9, 1.1, ("epoch",)), value=12)


@query(f"WITH {COEF}, mean AS (SELECT n, m, trig, avg(value) AS a FROM f_coef GROUP BY 1, 2, 3) SELECT epoch, n, m, trig, round(value - a, 12) AS value FROM f_coef JOIN mean USING (n, m, trig)")
def join02_minus_mean_field(spark, sf):
    field = rel.coefficients(spark, sf)
    mean = field.groupBy("n", "m", "trig").agg(F.avg("value").alias("mean"))  # one row a coefficient
    return rounded(field.join(F.broadcast(mean), ["n", "m", "trig"]).withColumn("value", F.col("value") - F.col("mean")).drop("mean"), value=12)


@query(f"WITH {COEF} SELECT epoch, n, round(sqrt(sum(value * value)), 12) AS amplitude FROM f_coef WHERE m <= 6 GROUP BY 1, 2")
def agg04_degree_amplitudes(spark, sf):
    return rounded(fields.degree_amplitudes(rel.coefficients(spark, sf), 6), amplitude=12)


@query(f"WITH RECURSIVE {POINT}, {LEG} SELECT point_id, n, m, round(p, 9) + 0e0 AS p FROM f_leg")
def fn01_legendre(spark, sf):
    points = rel.points(spark, sf).withColumn("colat", F.lit(1.5707963267948966) - F.col("lat"))
    return rounded(synthesis.legendre(points, 8), p=9)


@query(f"WITH {POINT}, x AS (SELECT point_id, lon, lat, 6378137e0 / sqrt(1 - e2 * sin(lat) * sin(lat)) AS nn, e2 FROM f_point, (SELECT 2e0 / 298.257222101e0 - 1e0 / (298.257222101e0 * 298.257222101e0) AS e2)) SELECT point_id, round(nn * cos(lat) * cos(lon), 4) + 0e0 AS x, round(nn * cos(lat) * sin(lon), 4) + 0e0 AS y, round(nn * (1 - e2) * sin(lat), 4) + 0e0 AS z, round(sqrt(nn * cos(lat) * nn * cos(lat) + nn * (1 - e2) * sin(lat) * nn * (1 - e2) * sin(lat)), 4) AS radius FROM x")
def fn12_cartesian(spark, sf):
    x, y, z = geodesy.geodetic_to_cartesian("lon", "lat")
    return rel.points(spark, sf).select("point_id", *[F.round(c, 4).alias(n) for n, c in (("x", x), ("y", y), ("z", z), ("radius", geodesy.geocentric_radius("lat")))])


@query(f"WITH {SERIES} SELECT event_id, round(mjd, 8) AS mjd FROM f_series")
def fn24_mjd(spark, sf):
    return rounded(rel.series(spark, sf).select("event_id", "mjd"), mjd=8)


@query("SELECT event_id, CAST(floor((datediff('day', DATE '1980-01-06', CAST(ts AS DATE))) / 7e0) AS BIGINT) AS week, CAST(datediff('day', DATE '1980-01-06', CAST(ts AS DATE)) % 7 * 86400 + extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(CAST(extract(second FROM ts) AS DOUBLE)) AS BIGINT) AS seconds, round(extract(year FROM ts) + datediff('day', make_date(extract(year FROM ts), 1, 1), CAST(ts AS DATE)) / CAST(datediff('day', make_date(extract(year FROM ts), 1, 1), make_date(extract(year FROM ts) + 1, 1, 1)) AS DOUBLE), 9) AS year FROM events")
def fn25_fn26_gps_and_decimal_year(spark, sf):
    week, seconds = time.gps_week_seconds("ts")
    return rel.table(spark, sf, "events").select("event_id", week.cast("long").alias("week"), seconds.cast("long").alias("seconds"), F.round(time.decimal_year("ts"), 9).alias("year"))


@query("SELECT CAST(k AS BIGINT) AS point_id, CAST(k // 72 AS INT) AS i_lat, CAST(k % 72 AS INT) AS i_lon, round(radians(-1775e-1 + 5e0 * (k % 72)), 12) AS lon, round(radians(875e-1 - 5e0 * (k // 72)), 12) AS lat, round(2e0 * radians(5e0) * sin(radians(25e-1)) * cos(radians(875e-1 - 5e0 * (k // 72))), 12) AS area FROM range(2592) t(k)")
def gen05_geographic_grid(spark, sf):
    return rounded(grids.geographic_grid(spark, 5.0, 5.0), lon=12, lat=12, area=12)


@query(f"WITH {POINT}, {BASIN} SELECT point_id, basin_id FROM f_point JOIN box ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def join08_points_in_basins(spark, sf):
    return grids.inside(rel.points(spark, sf), rel.basins(spark, sf))


@query(f"WITH {POINT}, {BASIN}, p AS (SELECT basin_id, value, cos(lat) AS area FROM f_point JOIN box ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1), s AS (SELECT basin_id, sum(area) AS a, sum(area * value) / sum(area) AS mean, sum(area * value * value) / sum(area) AS square FROM p GROUP BY 1) SELECT basin_id, round(mean, 6) AS mean, round(sqrt(square), 6) AS rms, round(sqrt(greatest(square - mean * mean, 0)), 6) AS std FROM s")
def agg01_agg02_agg03_basin_statistics(spark, sf):
    points = rel.points(spark, sf)
    inside = grids.inside(points, rel.basins(spark, sf))
    return rounded(grids.statistics(points.withColumn("area", F.cos("lat")).join(inside, "point_id"), ["basin_id"]), mean=6, rms=6, std=6)


@query(f"WITH {POINT}, {OTHER}, t AS (SELECT point_id AS target_id, lon AS lon2, lat AS lat2 FROM f_other), d AS (SELECT point_id, target_id, atan2(sqrt(pow(cos(lat2) * sin(lon2 - lon), 2) + pow(cos(lat) * sin(lat2) - sin(lat) * cos(lat2) * cos(lon2 - lon), 2)), sin(lat) * sin(lat2) + cos(lat) * cos(lat2) * cos(lon2 - lon)) AS psi FROM f_point, t) SELECT point_id, arg_min(target_id, psi) AS target_id, round(min(psi), 9) AS psi FROM d GROUP BY point_id")
def join04_nearest(spark, sf):
    """The customer nearest each supplier."""
    return rounded(grids.nearest(rel.points(spark, sf), rel.points(spark, sf, "customer")), psi=9)


@query(f"WITH RECURSIVE {COEF}, {POINT}, {LEG}, {SYNTH} SELECT epoch, point_id, round(value, 10) AS value FROM f_synth")
def syn01_synthesis(spark, sf):
    return rounded(synthesis.synthesise(rel.coefficients(spark, sf), rel.points(spark, sf), 8), value=10)


GRID = "f_point AS (SELECT CAST(k AS BIGINT) AS point_id, radians(-175e0 + 10e0 * (k % 36)) AS lon, radians(85e0 - 10e0 * (k // 36)) AS lat FROM range(648) t(k))"


@query(f"WITH RECURSIVE {COEF}, {GRID}, {LEG}, {SYNTH} SELECT epoch, point_id, round(value, 10) AS value FROM f_synth")
def syn01_synthesis_on_parallels(spark, sf):
    return rounded(synthesis.synthesise_grid(rel.coefficients(spark, sf), grids.geographic_grid(spark, 10.0, 10.0), 8), value=10)


@query(f"WITH RECURSIVE {COEF}, {POINT}, {LEG}, {SYNTH} SELECT point_id, round(sqrt(avg(value * value)), 10) AS rms FROM f_synth GROUP BY 1")
def agg06_gridded_rms(spark, sf):
    return rounded(synthesis.gridded_rms(synthesis.synthesise(rel.coefficients(spark, sf), rel.points(spark, sf), 8)), rms=10)


#: Weights of a Gaussian filter of 500 km from its recursion.
GAUSS = """gb AS (SELECT ln(2e0) / (1 - cos(500e0 / 6378.1366e0)) AS b),
gw(n, w, before) AS (SELECT 1, (1 + exp(-2 * b)) / (1 - exp(-2 * b)) - 1 / b, 1e0 FROM gb UNION ALL SELECT n + 1, before - (2 * n + 1) / b * w, w FROM gw, gb WHERE n < 8),
w AS (SELECT 0 AS n, 1e0 AS w UNION ALL SELECT n, w FROM gw)"""


@query(f"WITH RECURSIVE {COEF}, {GAUSS} SELECT epoch, n, m, trig, round(CASE WHEN n < 2 THEN value ELSE value * w END, 12) AS value FROM f_coef JOIN w USING (n)")
def fil02_gaussian(spark, sf):
    return rounded(fields.gaussian_filter(rel.coefficients(spark, sf), 500.0, 8), value=12)


@query(f"WITH {COEF} SELECT epoch, n, m, trig, round(value * pow(1 + pow(n / 4e0, 6e0), -5e-1), 12) AS value FROM f_coef")
def fil03_butterworth(spark, sf):
    return rounded(fields.butterworth_filter(rel.coefficients(spark, sf), 3, 4.0), value=12)


@query(f"WITH {SERIES} SELECT event_type, 60310e0 + 5 * greatest(0, least(5, floor((mjd - 60310) / 5 + 5e-1))) AS centre, count(*) AS n, round(avg(value), 8) AS mean FROM f_series GROUP BY 1, 2")
def agg07_bins(spark, sf):
    binned = series.bin_to_centres(rel.series(spark, sf), ["event_type"], 60310.0, 5.0, 6, F.struct(F.count("*").alias("n"), F.avg("value").alias("mean")).alias("x"))
    return binned.select("event_type", "centre", "x.n", F.round("x.mean", 8).alias("mean"))


@query(f"WITH {SERIES}, k AS (SELECT event_type, mjd, avg(value) AS v FROM f_series GROUP BY 1, 2), e AS (SELECT DISTINCT event_type, 60311e0 + 3 * x AS moment FROM f_series, range(9) r(x)), a AS (SELECT e.event_type, moment, max(mjd) AS t0 FROM e JOIN k ON k.event_type = e.event_type AND mjd <= moment GROUP BY 1, 2), b AS (SELECT e.event_type, moment, min(mjd) AS t1 FROM e JOIN k ON k.event_type = e.event_type AND mjd >= moment GROUP BY 1, 2) SELECT a.event_type, a.moment, round(CASE WHEN t0 = t1 THEN p.v ELSE p.v + (q.v - p.v) * (a.moment - t0) / (t1 - t0) END, 7) AS value FROM a JOIN b ON a.event_type = b.event_type AND a.moment = b.moment JOIN k p ON p.event_type = a.event_type AND p.mjd = t0 JOIN k q ON q.event_type = a.event_type AND q.mjd = t1")
def join14_interpolation(spark, sf):
    known = rel.series(spark, sf)
    epochs = known.select("event_type").distinct().withColumn("moment", F.explode(F.array(*[F.lit(60311.0 + 3 * k) for k in range(9)])))
    return rounded(series.interpolate(known, epochs, "event_type"), value=7)


@query(f"WITH {SERIES} SELECT event_type, round(regr_intercept(value, mjd - 60310), 7) AS constant, round(regr_slope(value, mjd - 60310), 8) AS slope FROM f_series GROUP BY 1")
def win04_trend(spark, sf):
    return rounded(series.trend(rel.series(spark, sf), ["event_type"], 60310.0), constant=7, slope=8)


@query(f"WITH {SERIES}, c AS (SELECT event_type, regr_intercept(value, mjd - 60310) AS c, regr_slope(value, mjd - 60310) AS s FROM f_series GROUP BY 1) SELECT event_id, event_type, round(value - c - s * (mjd - 60310), 6) AS value FROM f_series JOIN c USING (event_type)")
def win04_detrend(spark, sf):
    return rounded(series.detrend(rel.series(spark, sf), ["event_type"], 60310.0).select("event_id", "event_type", "value"), value=6)


@query(f"WITH {SERIES}, j AS (SELECT *, CASE WHEN mjd - lag(mjd) OVER (PARTITION BY user_id ORDER BY mjd, event_id) > 1 THEN 1 ELSE 0 END AS jump FROM f_series) SELECT event_id, user_id, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY mjd, event_id) AS BIGINT) AS segment FROM j")
def win09_segments(spark, sf):
    return series.segments(rel.series(spark, sf), "user_id", 1.0).select("event_id", "user_id", "segment")


@query(f"WITH {MAT} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 7) AS v FROM f_mat a JOIN f_mat b ON a.i = b.i GROUP BY 1, 2")
def lsq02_normal_matrix(spark, sf):
    return rounded(matrices.normals(rel.matrix(spark, sf)), v=7)


@query(f"WITH {MAT} SELECT i, j, round(v * 3e0, 7) AS v FROM f_mat")
def lsq07_scaled_sum(spark, sf):
    a = rel.matrix(spark, sf)
    return rounded(matrices.add_scaled(a, 2.0, a), v=7)


@query(f"WITH {MAT}, s AS (SELECT i % 4 AS sys_id, j, v, i FROM f_mat) SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v / (1e0 + a.sys_id)), 7) AS v FROM s a JOIN s b ON a.i = b.i GROUP BY 1, 2")
def lsq11_accumulated_normals(spark, sf):
    a = rel.matrix(spark, sf)
    systems = None
    for k in range(4):
        part = matrices.normals(a.where(F.col("i") % 4 == k)).withColumn("sys_id", F.lit(k))
        systems = part if systems is None else systems.unionByName(part)
    factors = spark.createDataFrame([(k, 1.0 + k) for k in range(4)], "sys_id int, factor double")
    return rounded(matrices.accumulate(systems, factors), v=7)
