"""Queries over kernels, sections, transport and autoregressive models, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy, harmonics, kernels
from ..operators import autoregression, elimination, filters, grids, series, transport
from . import relations as rel
from .geometry import LEGENDRE
from .queries import GAUSS, POINT, SERIES
from .registry import query, rounded

LOVE = "f_love AS (SELECT CAST(n AS INT) AS n, CASE WHEN n = 0 THEN 0e0 ELSE -1e0 / (n + 1e0) END AS h, CASE WHEN n = 0 THEN 0e0 ELSE 5e-2 / (n + 1e0) END AS l, CASE WHEN n < 2 THEN 0e0 ELSE -6e-1 / (n + 1e0) END AS k FROM range(9) t(n))"
GRAVITY = "grav AS (SELECT point_id, (9.7803267715e0 * 6378137e0 * cos(lat) * cos(lat) + 9.8321863685e0 * 6356752.3141e0 * sin(lat) * sin(lat)) / sqrt(pow(6378137e0 * cos(lat), 2) + pow(6356752.3141e0 * sin(lat), 2)) AS g, sqrt((pow(6378137e0 * 6378137e0 * cos(lat), 2) + pow(6356752.3141e0 * 6356752.3141e0 * sin(lat), 2)) / (pow(6378137e0 * cos(lat), 2) + pow(6356752.3141e0 * sin(lat), 2))) AS r FROM f_point)"


@query(f"WITH {POINT}, {LOVE}, {GRAVITY}, w AS (SELECT *, 4 * pi() * 6.673e-11 * (1 + k) / (2 * n + 1) AS load FROM grav, f_love) SELECT point_id, n, round(load * 1025e0 * r, 4) AS ewh, round(load * r / g * 1e6, 4) AS obp, round(g, 4) AS geoid, round(load * r * 1e3, 4) AS surface_density, round(CASE WHEN n = 1 THEN 0 ELSE r / (n - 1) END, 1) AS anomaly, round(CASE WHEN h = 0 THEN NULL ELSE g * (1 + k) / h END, 4) AS deformation, round(2 * g / (2 * n + 1), 4) AS uplift FROM w")
def ker09_to_ker18_kernels(spark, sf):
    f, a = geodesy.GRS80.f, geodesy.GRS80.a
    r, theta = geodesy.geocentric_radius("lat", a, f), geodesy.colatitude("lat", a, f)
    points = rel.points(spark, sf).select("point_id", r.alias("r"), geodesy.GRS80.normal_gravity(r, theta).alias("g"))
    rows = points.crossJoin(F.broadcast(rel.love_numbers(spark)))  # nine degrees
    scale = {"ewh": (1, 4), "obp": (1e6, 4), "geoid": (1, 4), "surface_density": (1e3, 4), "anomaly": (1, 1), "deformation": (1, 4), "uplift": (1, 4)}
    args = [F.col(c) for c in ("n", "r", "g", "k", "h")]
    return rows.select("point_id", "n", *[F.round(kernels.kernel(name)(*args) * by, digits).alias(name) for name, (by, digits) in scale.items()])


@query(f"WITH {LOVE} SELECT 'CM' AS frame, n, round(h - (CASE WHEN n = 1 THEN 1 ELSE 0 END), 9) AS h, round(l - (CASE WHEN n = 1 THEN 1 ELSE 0 END), 9) AS l, round(k - (CASE WHEN n = 1 THEN 1 ELSE 0 END), 9) AS k FROM f_love UNION ALL SELECT 'CF', n, round(CASE WHEN n = 1 THEN (h - l) * 2 / 3 ELSE h END, 9), round(CASE WHEN n = 1 THEN (l - h) / 3 ELSE l END, 9), round(CASE WHEN n = 1 THEN -(h + 2 * l) / 3 ELSE k END, 9) FROM f_love")
def src20_love_numbers_in_frames(spark, sf):
    love = rel.love_numbers(spark)
    both = [kernels.in_frame(love, f).select(F.lit(f).alias("frame"), "n", "h", "l", "k") for f in ("CM", "CF")]
    return rounded(both[0].unionByName(both[1]), h=9, l=9, k=9)


@query(f"WITH RECURSIVE {POINT}, {LEGENDRE}, {GAUSS} SELECT point_id, round(sum(w * (2 * n + 1) * p), 8) AS value FROM leg JOIN w USING (n) GROUP BY 1")
def ker05_ker14_kernel_around_the_pole(spark, sf):
    """Gauss weights summed to a function of the distance from the north pole."""
    weights = [w * math.sqrt(2 * n + 1) for n, w in enumerate(kernels.gauss_weights(500.0, 8))]
    return rel.points(spark, sf).select("point_id", F.round(harmonics.legendre_sum(F.array(*map(F.lit, weights)), F.sin("lat")), 8).alias("value"))


@query("SELECT CAST(n AS INT) AS n, round(1 / (1 + n) * (2e0 + 1e0) / (n + 1), 9) AS v FROM range(9) t(n)")
def fil10_filter_kernel(spark, sf):
    diagonal = spark.range(9).select(*[F.col("id").cast("int").alias(c) for c in ("i_n", "n")], (1.0 / (F.col("id") + 1)).alias("v"))
    return rounded(filters.filter_kernel(diagonal, lambda n: 3.0 / (n + 1.0), lambda n: F.lit(1.0)).select("n", "v"), v=9)


LINE = "raw AS (SELECT k, k * 5e5 AS path, k * 5e5 / 6378137e0 * cos(7e-1) + 2e-1 AS b FROM range(-40, 41) t(k)), fold AS (SELECT k, path, CASE WHEN b > pi() / 2 THEN pi() - b WHEN b < -pi() / 2 THEN -b - pi() ELSE b END AS lat FROM raw), line AS (SELECT *, 1e-1 + tan(7e-1) * (ln(tan(lat / 2 + pi() / 4)) - ln(tan(1e-1 + pi() / 4))) AS lon FROM fold)"


@query(f"WITH {LINE} SELECT k, round(lon, 9) AS lon, round(lat, 9) AS lat, round(1000e0 + 10 * degrees(lon) + 20 * degrees(lat), 6) AS value FROM line WHERE abs(degrees(lon)) <= 60 AND abs(degrees(lat)) <= 60")
def trn01_section(spark, sf):
    """A plane of depths, which bilinear interpolation gives exactly."""
    nodes = spark.range(169).select((F.col("id") % 13).cast("int").alias("i_lon"), F.floor(F.col("id") / 13).cast("int").alias("i_lat"))
    depths = nodes.withColumn("value", 1000.0 + 10 * (10.0 * F.col("i_lon") - 60) + 20 * (10.0 * F.col("i_lat") - 60))
    line = transport.loxodrome(spark, 0.1, 0.2, 0.7, 5e5)
    found = transport.bilinear(line, depths, math.radians(-60), math.radians(-60), math.radians(10), math.radians(10))
    return rounded(found.select("k", "lon", "lat", "value"), lon=9, lat=9, value=6)


SECTION = "s AS (SELECT k, k * 1e4 AS path, 5e-1 AS lat, k * 1e4 / (6378137e0 * cos(5e-1)) AS lon, 10e0 * k + 1e-1 * k * k AS z FROM range(101) t(k)), d AS (SELECT *, CASE WHEN k = 0 THEN 101e-1 / 1e4 WHEN k = 100 THEN (10 + 199e-1) / 1e4 ELSE (10 + 2e-1 * k) / 1e4 END AS dz FROM s)"


def _section(spark):
    k = F.col("id")
    path = k * 1e4
    return transport.slopes(spark.range(101).select(path.alias("path"), (path / (6378137.0 * math.cos(0.5))).alias("lon"), F.lit(0.5).alias("lat"), (10.0 * k + 0.1 * k * k).alias("z")))


@query(f"WITH {SECTION}, p AS (SELECT e AS epoch, l AS layer, path, CASE WHEN z >= 700 * l AND z <= 700 * l + 700 THEN dz * (2 + e * sin(path / 1e5)) ELSE 0 END AS y FROM d, range(3) a(e), range(2) b(l)), t AS (SELECT epoch, layer, (y + lead(y) OVER w) / 2 * 1e4 AS strip FROM p WINDOW w AS (PARTITION BY epoch, layer ORDER BY path)) SELECT epoch, CAST(layer AS INT) AS layer, round(sum(strip) / (1025e0 * 2 * 7.29211585531e-5 * sin(5e-1)), 4) AS transport FROM t GROUP BY 1, 2")
def trn05_spatial_transport(spark, sf):
    section = _section(spark)
    pressure = section.select("path", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch")).select(F.col("epoch").cast("long").alias("epoch"), "path", (2 + F.col("epoch") * F.sin(F.col("path") / 1e5)).alias("value"))
    return rounded(transport.spatial(section, pressure, [0, 700, 1400]), transport=4)


@query()
def trn04_spectral_transport(spark, sf):
    factors = transport.spectral_factors(_section(spark), rel.love_numbers(spark), [0, 700, 1400], 8)
    return transport.spectral(rel.coefficients(spark, sf), factors)


@query(f"WITH {SECTION} SELECT round(2 * 7.29211585531e-5 * sin(median(lat)), 12) AS coriolis, true AS parallel, false AS meridian FROM s")
def trn02_coriolis(spark, sf):
    return rounded(transport.mean_coriolis(_section(spark)), coriolis=12)


DAILY = f"{SERIES}, x AS (SELECT CAST(floor(mjd) AS INT) AS t, user_id % 3 AS i, avg(value) AS x FROM f_series GROUP BY 1, 2)"


@query(f"WITH {DAILY} SELECT CAST(l AS INT) AS lag, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(avg(a.x * b.x), 6) AS v FROM x a, x b, range(3) t(l) WHERE a.t = b.t + l GROUP BY 1, 2, 3")
def lsq14_lagged_covariances(spark, sf):
    daily = rel.series(spark, sf).groupBy(F.floor("mjd").cast("int").alias("t"), (F.col("user_id") % 3).cast("int").alias("i")).agg(F.avg("value").alias("x"))
    return rounded(autoregression.lagged_covariances(daily, 2), v=6)


@query()
def win09_component_spectrum(spark, sf):
    """Hourly means of each type of event about the type's mean, in segments of at most sixteen hours."""
    hourly = rel.series(spark, sf).groupBy("event_type", F.floor(F.col("mjd") * 24).alias("hour")).agg(F.avg("value").alias("x"))
    mean = hourly.groupBy("event_type").agg(F.avg("x").alias("mean"))
    rows = hourly.join(mean, "event_type").select("event_type", F.col("hour").cast("double").alias("mjd"), (F.col("x") - F.col("mean")).alias("value"))
    return series.component_spectrum(rows, ["event_type"], 1.0, 16, iterations=3)


YULE = f"""{SERIES}, day AS (SELECT CAST(floor(mjd) AS BIGINT) AS t, avg(value) AS x FROM f_series GROUP BY 1), x AS (SELECT t - (SELECT min(t) FROM day) AS t, x - (SELECT avg(x) FROM day) AS x FROM day),
cov AS (SELECT avg(CASE WHEN l = 0 THEN p END) AS c0, avg(CASE WHEN l = 1 THEN p END) AS c1, avg(CASE WHEN l = 2 THEN p END) AS c2 FROM (SELECT a.x * b.x AS p, a.t - b.t AS l FROM x a JOIN x b ON a.t - b.t BETWEEN 0 AND 2) p),
ar AS (SELECT *, c1 / c0 AS p1, c0 - c1 * c1 / c0 AS q1, c1 * (c0 - c2) / (c0 * c0 - c1 * c1) AS b1, (c0 * c2 - c1 * c1) / (c0 * c0 - c1 * c1) AS b2 FROM cov),
m AS (SELECT *, c0 - b1 * c1 - b2 * c2 AS q2 FROM ar)"""


def _daily_models(spark, sf):
    """Models of order 0 to 2 of the daily means of all events about their mean, and the number of days."""
    daily = rel.series(spark, sf).groupBy(F.floor("mjd").alias("t")).agg(F.avg("value").alias("x"))
    mean, first, days = daily.agg(F.avg("x"), F.min("t"), F.count("*")).first()
    sample = daily.select((F.col("t") - first).alias("t"), F.lit(0).alias("i"), (F.col("x") - mean).alias("x"))
    lags = sorted(autoregression.lagged_covariances(sample, 2).collect(), key=lambda r: r["lag"])
    return autoregression.sequence([[[r["v"]]] for r in lags]), days


@query(f"""WITH {YULE}, term(p, a, w, q) AS (SELECT 0, 0, -1e0, c0 FROM m UNION ALL SELECT 1, 0, p1, q1 FROM m UNION ALL SELECT 1, 1, -1e0, q1 FROM m UNION ALL SELECT 2, 0, b2, q2 FROM m UNION ALL SELECT 2, 1, b1, q2 FROM m UNION ALL SELECT 2, 2, -1e0, q2 FROM m),
e AS (SELECT k AS t, least(k, 2) AS p FROM range((SELECT count(*) FROM day)) r(k))
SELECT CAST(e.t - e.p + u.a AS BIGINT) AS i, CAST(e.t - e.p + v.a AS BIGINT) AS j, round(sum(u.w * v.w / u.q), 8) AS v FROM e JOIN term u ON u.p = e.p JOIN term v ON v.p = e.p GROUP BY 1, 2""")
def lsq15_sequence_normals(spark, sf):
    models, days = _daily_models(spark, sf)
    return rounded(elimination.to_entries(autoregression.sequence_blocks(spark, models, days), 1), v=8)


@query(f"WITH RECURSIVE {YULE}, line(lag, v, before) AS (SELECT CAST(1 AS BIGINT), c1, c0 FROM m UNION ALL SELECT lag + 1, b1 * v + b2 * before, v FROM line, m WHERE lag + 1 < (SELECT count(*) FROM day)) SELECT lag, round(v, 7) AS v FROM line UNION ALL SELECT 0, round(c0, 7) FROM m")
def lsq15_covariance_function(spark, sf):
    """Out of the inverse of the banded normals; the oracle goes on by the model's own recursion."""
    models, days = _daily_models(spark, sf)
    return rounded(autoregression.sequence_covariances(spark, models, days - 1, 8).select("lag", "v"), v=7)


@query("SELECT k / 20e0 AS frequency, CAST(0 AS INT) AS i, round(4 / (1 + 25e-2 - cos(2 * pi() * k / 20e0)), 9) AS psd FROM range(11) t(k)")
def lsq18_spectrum_of_a_model(spark, sf):
    model = autoregression.Model([[[0.5]]], [[4.0]])
    return rounded(model.spectrum(spark.range(11).select((F.col("id") / 20.0).alias("frequency"))), psd=9)


@query(f"WITH {POINT}, c AS (SELECT k AS target_id, radians(-165e0 + 30 * (k % 12)) AS lon2, radians(75e0 - 30 * (k // 12)) AS lat2 FROM range(72) t(k)), d AS (SELECT point_id, target_id, sin(lat) * sin(lat2) + cos(lat) * cos(lat2) * cos(lon2 - lon) AS s FROM f_point, c) SELECT point_id, arg_max(target_id, s) AS target_id FROM d GROUP BY 1")
def join04_nearest_grid_point(spark, sf):
    return grids.nearest(rel.points(spark, sf), grids.geographic_grid(spark, 30.0, 30.0)).select("point_id", "target_id")


@query(f"WITH {POINT}, c AS (SELECT k AS target_id, radians(-165e0 + 30 * (k % 12)) AS lon2, radians(75e0 - 30 * (k // 12)) AS lat2 FROM range(72) t(k)) SELECT point_id, target_id, round(acos(greatest(-1, least(1, sin(lat) * sin(lat2) + cos(lat) * cos(lat2) * cos(lon2 - lon)))), 6) AS psi FROM f_point, c")
def join10_distances_to_grid(spark, sf):
    """Distances of all points to a whole grid."""
    return rounded(grids.distances(rel.points(spark, sf), grids.geographic_grid(spark, 30.0, 30.0)), psi=6)


@query(f"WITH {POINT}, c AS (SELECT k AS target_id, radians(-165e0 + 30 * (k % 12)) AS lon2, radians(75e0 - 30 * (k // 12)) AS lat2 FROM range(72) t(k)), d AS (SELECT point_id, target_id, value, sin(lat) * sin(lat2) + cos(lat) * cos(lat2) * cos(lon2 - lon) AS s FROM f_point, c), b AS (SELECT point_id, arg_max(target_id, s) AS target_id, any_value(value) AS value FROM d GROUP BY 1) SELECT target_id, count(*) AS n, round(avg(value), 6) AS mean FROM b GROUP BY 1")
def agg09_cells_of_grid(spark, sf):
    """All points by the nearest point of a whole grid."""
    return rounded(grids.cells_of(rel.points(spark, sf), grids.geographic_grid(spark, 30.0, 30.0)), mean=6)
