"""Queries over basins and time series, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, polygons, series
from . import relations as rel
from .queries import BASIN, COEF, POINT, SERIES
from .registry import query, rounded

# A great circle through both ends of an edge on the parallels at 30 degrees: its latitude at the point's longitude.
BULGE = f"{POINT}, {BASIN}, inside AS (SELECT point_id, basin_id, lon, lat, value FROM f_point JOIN box ON lon > x0 AND lon < x1 WHERE abs(tan(lat)) < tan(y1) * cos(lon - (x0 + x1) / 2) / cos((x1 - x0) / 2))"


@query(f"WITH {BULGE} SELECT point_id, basin_id FROM inside")
def join05_join06_points_in_spherical_basins(spark, sf):
    return polygons.contains(rel.points(spark, sf), rel.basins(spark, sf), f=0.0)


EDGES = "edge AS (SELECT basin_id, x0 AS l0, y0 AS p0, x1 AS l1, y0 AS p1 FROM box UNION ALL SELECT basin_id, x1, y0, x1, y1 FROM box UNION ALL SELECT basin_id, x1, y1, x0, y1 FROM box UNION ALL SELECT basin_id, x0, y1, x0, y0 FROM box), course AS (SELECT point_id, basin_id, acos(sin(p0) * sin(lat) + cos(p0) * cos(lat) * cos(lon - l0)) AS d, acos(sin(p1) * sin(lat) + cos(p1) * cos(lat) * cos(lon - l1)) AS d9, acos(sin(p0) * sin(p1) + cos(p0) * cos(p1) * cos(l1 - l0)) AS len, atan2(sin(lon - l0) * cos(lat), cos(p0) * sin(lat) - sin(p0) * cos(lat) * cos(lon - l0)) - atan2(sin(l1 - l0) * cos(p1), cos(p0) * sin(p1) - sin(p0) * cos(p1) * cos(l1 - l0)) AS turn FROM f_point, edge), near AS (SELECT DISTINCT point_id, basin_id FROM course WHERE least(d, d9) <= 2e6 / 6378137e0 OR (abs(asin(sin(d) * sin(turn))) <= 2e6 / 6378137e0 AND atan2(sin(d) * cos(turn), cos(d)) BETWEEN 0 AND len))"


@query(f"WITH {POINT}, {BASIN}, {EDGES} SELECT point_id, basin_id FROM near")
def join07_points_near_edges(spark, sf):
    return polygons.near_edges(rel.points(spark, sf), rel.basins(spark, sf), 2e6, f=0.0)


@query(f"WITH {BULGE}, {EDGES} SELECT point_id, basin_id FROM inside UNION SELECT point_id, basin_id FROM near")
def join05_basins_with_buffer(spark, sf):
    return polygons.contains(rel.points(spark, sf), rel.basins(spark, sf), 2e6, f=0.0)


@query(f"WITH {BULGE}, {EDGES} SELECT point_id, basin_id FROM inside EXCEPT SELECT point_id, basin_id FROM near")
def join05_basins_without_margin(spark, sf):
    return polygons.contains(rel.points(spark, sf), rel.basins(spark, sf), -2e6, f=0.0)


@query(f"WITH {POINT}, {BASIN} SELECT point_id, basin_id FROM f_point JOIN box ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def join08_winding_number(spark, sf):
    return grids.inside(rel.points(spark, sf), rel.basins(spark, sf), "winding")


@query(f"WITH {BASIN} SELECT basin_id, round(x0, 10) AS west, round(y0, 10) AS south, round(x1, 10) AS east, round(y1, 10) AS north FROM box")
def join09_bounding_boxes(spark, sf):
    return rounded(polygons.bounding_boxes(rel.basins(spark, sf)), west=10, south=10, east=10, north=10)


@query(f"WITH {BULGE}, m AS (SELECT DISTINCT point_id FROM inside) SELECT p.point_id, m.point_id IS NOT NULL AS inside FROM f_point p LEFT JOIN m USING (point_id)")
def prj13_mask(spark, sf):
    points = rel.points(spark, sf)
    found = polygons.contains(points, rel.basins(spark, sf), f=0.0).select("point_id").distinct().withColumn("inside", F.lit(True))
    return points.join(found, "point_id", "left").select("point_id", F.coalesce("inside", F.lit(False)).alias("inside"))


WAVE = "(SELECT event_id, event_type, value AS v, cos(2 * pi() / 10 * (mjd - 60310)) AS c, sin(2 * pi() / 10 * (mjd - 60310)) AS s FROM f_series)"
FIT = f"g AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, sum(c) AS c, sum(s) AS s, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(v) AS v, sum(c * v) AS cv, sum(s * v) AS sv FROM {WAVE} GROUP BY 1), f AS (SELECT event_type, n * (cc * ss - cs * cs) - c * (c * ss - cs * s) + s * (c * cs - cc * s) AS det, v * (cc * ss - cs * cs) - c * (cv * ss - cs * sv) + s * (cv * cs - cc * sv) AS d0, n * (cv * ss - cs * sv) - v * (c * ss - cs * s) + s * (c * sv - cv * s) AS d1, n * (cc * sv - cv * cs) - c * (c * sv - cv * s) + v * (c * cs - cc * s) AS d2 FROM g)"


@query(f"WITH {SERIES}, {FIT} SELECT event_type, round(d0 / det, 7) AS t0, round(d1 / det, 7) AS cos10, round(d2 / det, 7) AS sin10 FROM f")
def win04_win07_fit_of_basis(spark, sf):
    basis = series.polynomial(0) | series.oscillation(10.0, 60310.0)
    return rounded(series.fit(rel.series(spark, sf), ["event_type"], basis), t0=7, cos10=7, sin10=7)


@query(f"WITH {SERIES}, {FIT} SELECT event_id, round(v - (d0 + d1 * c + d2 * s) / det, 6) AS value FROM {WAVE} JOIN f USING (event_type)")
def win04_reduced_by_basis(spark, sf):
    basis = series.polynomial(0) | series.oscillation(10.0, 60310.0)
    return rounded(series.reduce_by(rel.series(spark, sf), ["event_type"], basis).select("event_id", "value"), value=6)


@query(f"WITH {COEF}, m AS (SELECT n, m, trig, avg(value) AS v FROM f_coef GROUP BY 1, 2, 3) SELECT n, m, trig, mjd, round(v * (mjd - 60310) / 36525e-2 + v * cos(2 * pi() * (mjd - 60310) / 36525e-2) + 2 * v * sin(2 * pi() * (mjd - 60310) / 36525e-2), 12) AS value FROM m, (VALUES (60400e0), (60500e0), (60600e0)) t(mjd)")
def win05_win06_agg08_parametric_series(spark, sf):
    mean = rel.coefficients(spark, sf).groupBy("n", "m", "trig").agg(F.avg("value").alias("value"))
    moments = [60400.0, 60500.0, 60600.0]
    rate = series.evaluate_trend(mean, moments, 60310.0)
    wave = series.evaluate_oscillation(mean, mean.withColumn("value", 2 * F.col("value")), moments, 365.25, 60310.0)
    return rounded(series.total(rate, wave), value=12)


@query(f"WITH {COEF} SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY n, m, trig) - 1 AS INT) AS pos, round(value, 12) AS value FROM f_coef")
def win03_prj10_packed_vectors(spark, sf):
    field = rel.coefficients(spark, sf).withColumn("idx", rel.packed_index())
    return rounded(series.packed(field).select("epoch", F.posexplode("values").alias("pos", "value")), value=12)


@query(f"WITH {SERIES}, c AS (SELECT DISTINCT event_type, 60300e0 + 5 * k AS centre, k FROM f_series, range(9) t(k)), b AS (SELECT event_type, CAST(greatest(0, least(8, floor((mjd - 60300) / 5 + 5e-1))) AS BIGINT) AS k, avg(value) AS mean FROM f_series GROUP BY 1, 2) SELECT event_type, centre, round(coalesce(mean, -1), 8) AS mean FROM c LEFT JOIN b USING (event_type, k)")
def agg07_bins_with_gaps(spark, sf):
    return rounded(series.bins_with_gaps(rel.series(spark, sf), ["event_type"], 60300.0, 5.0, 9, -1.0), mean=8)


HOURLY = f"{SERIES}, h AS (SELECT event_type, floor((mjd - 60310) * 4) / 4e0 AS mjd, avg(value) AS v FROM f_series GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mjd) - 1 AS i FROM h), z AS (SELECT *, count(*) OVER (PARTITION BY event_type, i // 16) AS size FROM r), w AS (SELECT event_type, v, k, CASE WHEN k = 0 THEN 1e0 WHEN k = 8 THEN CASE WHEN i % 2 = 1 THEN -1e0 ELSE 1e0 END ELSE cos(2 * pi() * k * mjd / 4e0) END AS c, CASE WHEN k IN (0, 8) THEN 0e0 ELSE sin(2 * pi() * k * mjd / 4e0) END AS s FROM z, range(9) t(k) WHERE size >= 3)"


@query(f"WITH {HOURLY}, u AS (SELECT event_type, k, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(c * v) AS cv, sum(s * v) AS sv FROM w GROUP BY 1, 2) SELECT event_type, k / 4e0 AS frequency, round(CASE WHEN k IN (0, 8) THEN cv * cv / cc ELSE (ss * cv * cv - 2 * cs * cv * sv + cc * sv * sv) / (cc * ss - cs * cs) END / 25e-2 * sqrt(2e0), 5) AS psd FROM u")
def win08_spectrum(spark, sf):
    quarter = (F.floor((F.col("mjd") - 60310.0) * 4) / 4).alias("mjd")
    regular = rel.series(spark, sf).groupBy("event_type", quarter).agg(F.avg("value").alias("value"))
    return rounded(series.spectrum(regular, ["event_type"], 0.25, 16), psd=5)
