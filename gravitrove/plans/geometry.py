"""Queries over functions, dates and grids, and their SQL."""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import functions as F

from ..functions import geodesy, harmonics, time
from ..operators import dates, grids
from . import relations as rel
from .queries import OTHER, POINT
from .registry import query, rounded

ECC = "(SELECT 2e0 / 298.257222101e0 - 1e0 / (298.257222101e0 * 298.257222101e0) AS e2) ecc"
LEGENDRE = "leg(point_id, t, n, p, q, d, e, dd, ee) AS (SELECT point_id, sin(lat), 0, 1e0, 0e0, 0e0, 0e0, 0e0, 0e0 FROM f_point UNION ALL SELECT point_id, t, n + 1, ((2e0 * n + 1) * t * p - n * q) / (n + 1e0), p, (2e0 * n + 1) * p + e, d, (2e0 * n + 1) * d + ee, dd FROM leg WHERE n < 8)"


@query(f"WITH RECURSIVE {POINT}, {LEGENDRE} SELECT point_id, n, round(p * sqrt(2e0 * n + 1), 9) AS p, round(d * sqrt(2e0 * n + 1), 8) AS d1, round(dd * sqrt(2e0 * n + 1), 7) AS d2 FROM leg")
def fn03_legendre_polynomials(spark, sf):
    rows = rel.points(spark, sf).select("point_id", F.explode(harmonics.legendre_polynomials(F.sin("lat"), 8)).alias("x"))
    return rounded(rows.select("point_id", "x.*"), p=9, d1=8, d2=7)


@query(f"WITH RECURSIVE {POINT}, {LEGENDRE} SELECT point_id, round(sum(p * sqrt(2e0 * n + 1) / (n + 1e0)), 9) AS value FROM leg GROUP BY 1")
def fn04_legendre_sum(spark, sf):
    factors = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: 1.0 / (n + 1.0))
    return rel.points(spark, sf).select("point_id", F.round(harmonics.legendre_sum(factors, F.sin("lat")), 9).alias("value"))


@query(f"WITH RECURSIVE {POINT}, {LEGENDRE} SELECT point_id, round(sum(d * sqrt(2e0 * n + 1) / (n + 1e0)), 8) AS first, round(sum(dd * sqrt(2e0 * n + 1) / (n + 1e0)), 6) AS second FROM leg GROUP BY 1")
def fn04_legendre_sum_derivatives(spark, sf):
    factors = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: 1.0 / (n + 1.0))
    sums = [F.round(harmonics.legendre_sum(factors, F.sin("lat"), k), d).alias(c) for k, d, c in ((1, 8, "first"), (2, 6, "second"))]
    return rel.points(spark, sf).select("point_id", *sums)


@query(f"WITH RECURSIVE {POINT}, {LEGENDRE} SELECT point_id, round(sum(4e0 / pow(25e-2 + n * n, 2e0) * (2 * n + 1) * sqrt(2e0 * n + 1) * p), 8) AS covariance FROM leg WHERE n >= 2 GROUP BY 1")
def fn22_legendre_matern(spark, sf):
    factors = F.array(*map(F.lit, harmonics.matern_variances(2.0, 0.5, 1.5, 8)))
    return rel.points(spark, sf).select("point_id", F.round(harmonics.legendre_sum(factors, F.sin("lat")), 8).alias("covariance"))


@query(f"WITH {POINT} SELECT point_id, round(lon, 10) AS lon, round(lat, 10) AS lat, round(1000e0 + point_id, 5) AS h FROM f_point")
def fn13_geodetic_from_cartesian(spark, sf):
    xyz = geodesy.geodetic_to_cartesian("lon", "lat", F.lit(1000.0) + F.col("point_id"))
    there = rel.points(spark, sf).select("point_id", *[c.alias(n) for n, c in zip("xyz", xyz)])
    lon, lat, h = geodesy.cartesian_to_geodetic("x", "y", "z")
    return there.select("point_id", F.round(lon, 10).alias("lon"), F.round(lat, 10).alias("lat"), F.round(h, 5).alias("h"))


@query(f"WITH {POINT}, q AS (SELECT *, cos(lat) AS x, atan2(sqrt(pow(cos(lat) * cos(lon), 2) + pow(cos(lat) * sin(lon), 2)), sin(lat)) AS th FROM f_point) SELECT point_id, round(7e6, 4) AS r, round(th, 10) AS colat, round(lon, 10) AS lon FROM q")
def fn14_fn15_spherical_round_trip(spark, sf):
    xyz = geodesy.spherical_to_cartesian(F.lit(7e6), math.pi / 2 - F.col("lat"), "lon")
    there = rel.points(spark, sf).select("point_id", *[c.alias(n) for n, c in zip("xyz", xyz)])
    r, colat, lon = geodesy.cartesian_to_spherical("x", "y", "z")
    return there.select("point_id", F.round(r, 4).alias("r"), F.round(colat, 10).alias("colat"), F.round(lon, 10).alias("lon"))


@query(f"WITH {POINT}, e AS (SELECT point_id, lat, e2, sqrt(e2) AS e, sin(lat) AS s FROM f_point, {ECC}) SELECT point_id, round(asin((s / (1 - e2 * s * s) + ln((1 + e * s) / (1 - e * s)) / (2 * e)) / (1 / (1 - e2) + ln((1 + e) / (1 - e)) / (2 * e))), 10) AS authalic, round(2 * atan(tan(lat / 2 + pi() / 4) * pow((1 - e * s) / (1 + e * s), e / 2)) - pi() / 2, 10) AS conformal, round(atan((1 - e2) * tan(lat)), 10) AS geocentric FROM e")
def fn17_fn18_fn19_latitudes(spark, sf):
    return rel.points(spark, sf).select("point_id", F.round(geodesy.geodetic_to_authalic("lat"), 10).alias("authalic"), F.round(geodesy.geodetic_to_conformal("lat"), 10).alias("conformal"), F.round(geodesy.geodetic_to_geocentric("lat"), 10).alias("geocentric"))


@query(f"WITH {POINT} SELECT point_id, round(lat, 8) AS conformal, round(lat, 10) AS geocentric FROM f_point")
def fn18_fn19_latitudes_back(spark, sf):
    there = rel.points(spark, sf).select("point_id", geodesy.geodetic_to_conformal("lat").alias("c"), geodesy.geodetic_to_geocentric("lat").alias("g"))
    return there.select("point_id", F.round(geodesy.conformal_to_geodetic("c"), 8).alias("conformal"), F.round(geodesy.geocentric_to_geodetic("g"), 10).alias("geocentric"))


@query(f"WITH {POINT} SELECT point_id, round((9.7803267715e0 * 6378137e0 * cos(lat) * cos(lat) + 9.8321863685e0 * 6356752.3141e0 * sin(lat) * sin(lat)) / sqrt(pow(6378137e0 * cos(lat), 2) + pow(6356752.3141e0 * sin(lat), 2)), 6) AS gravity FROM f_point")
def ker20_normal_gravity(spark, sf):
    """On the ellipsoid, where Somigliana's closed formula is the oracle."""
    f, a = geodesy.GRS80.f, geodesy.GRS80.a
    gravity = geodesy.GRS80.normal_gravity(geodesy.geocentric_radius("lat", a, f), geodesy.colatitude("lat", a, f))
    return rel.points(spark, sf).select("point_id", F.round(gravity, 6).alias("gravity"))


@query("SELECT event_id, CAST(DATE '1980-01-06' + CAST(floor(datediff('day', DATE '1980-01-06', CAST(ts AS DATE)) / 7e0) AS INT) * 7 + CAST(datediff('day', DATE '1980-01-06', CAST(ts AS DATE)) % 7 AS INT) AS DATE) AS epoch, round(datediff('day', DATE '1858-11-17', make_date(2024, 1, 1)) + 366e0 * (event_id % 1000) / 1000e0, 8) AS mjd FROM events")
def fn25_fn26_dates_back(spark, sf):
    week, day = time.gps_week_day("ts")
    return rel.table(spark, sf, "events").select("event_id", time.gps_week_day_to_date(week, day).alias("epoch"), F.round(time.decimal_year_to_mjd(2024 + F.col("event_id") % 1000 / 1000), 8).alias("mjd"))


@query("SELECT 'step' AS kind, CAST(TIMESTAMP '2004-02-27' + k * INTERVAL 30 HOUR AS TIMESTAMP) AS epoch FROM range(5) t(k) WHERE k * 30 < 144 UNION ALL SELECT 'back', TIMESTAMP '2004-03-04' - k * INTERVAL 30 HOUR FROM range(5) t(k) UNION ALL SELECT 'year', make_date(CAST(2003 + k AS INT), 1, 1) + CASE WHEN (2003 + k) % 4 = 0 THEN INTERVAL 4392 HOUR ELSE INTERVAL 4380 HOUR END FROM range(3) t(k) UNION ALL SELECT 'month', x FROM (VALUES (TIMESTAMP '2004-01-16'), (TIMESTAMP '2004-02-14'), (TIMESTAMP '2004-03-16'), (TIMESTAMP '2004-04-15')) v(x) UNION ALL SELECT 'day', TIMESTAMP '2004-02-27 12:00:00' + k * INTERVAL 24 HOUR FROM range(6) t(k)")
def gen01_gen02_gen03_gen04_epochs(spark, sf):
    a, b = dt.datetime(2004, 2, 27), dt.datetime(2004, 3, 4)
    made = {
        "step": dates.epochs(spark, a, b, dt.timedelta(hours=30)),
        "back": dates.epochs(spark, b, a, -dt.timedelta(hours=30)),
        "year": dates.years(spark, dt.datetime(2003, 5, 1), dt.datetime(2006, 1, 1), True),
        "month": dates.months(spark, dt.datetime(2004, 1, 20), dt.datetime(2004, 5, 1), True),
        "day": dates.days(spark, a, b, True),
    }
    rows = None
    for kind, df in made.items():
        df = df.select(F.lit(kind).alias("kind"), "epoch")
        rows = df if rows is None else rows.unionByName(df)
    return rows


@query("""WITH b AS (SELECT min(ts) AS a, max(ts) AS z FROM events), s AS (SELECT min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem), y AS (SELECT unnest(range(year(a), year(z) + 1)) AS y, z FROM s),
m AS (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS d, z FROM s)
SELECT 'step' AS kind, CAST(a + k * INTERVAL 7 HOUR AS TIMESTAMP) AS epoch FROM b, range(200) t(k) WHERE a + k * INTERVAL 7 HOUR < z UNION ALL SELECT 'day', CAST(d AS TIMESTAMP) FROM (SELECT unnest(generate_series(date_trunc('day', a), date_trunc('day', z), INTERVAL 1 DAY)) AS d, z FROM b) x WHERE d < z
UNION ALL SELECT 'month', CAST(d AS TIMESTAMP) FROM m WHERE d < z UNION ALL SELECT 'year', CAST(make_date(CAST(y AS INT), 1, 1) AS TIMESTAMP) FROM y WHERE make_date(CAST(y AS INT), 1, 1) < z""")
def gen01_gen02_gen03_gen04_epochs_of_the_tables(spark, sf):
    """Every seven hours and every day of the events, every month and year of the shipments; the ends are not included."""
    a, z = rel.table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    first, last = rel.table(spark, sf, "lineitem").agg(F.min("l_shipdate").cast("timestamp_ntz"), F.max("l_shipdate").cast("timestamp_ntz")).first()
    made = {"step": dates.epochs(spark, a, z, dt.timedelta(hours=7)), "day": dates.days(spark, a, z), "month": dates.months(spark, first, last), "year": dates.years(spark, first, last)}
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(k).alias("kind"), "epoch") for k, df in made.items()])


@query("WITH r(i_lat, x, w) AS (VALUES (0, sqrt(3e0 / 7 + 2e0 / 7 * sqrt(12e-1)), (18 - sqrt(30e0)) / 36), (1, sqrt(3e0 / 7 - 2e0 / 7 * sqrt(12e-1)), (18 + sqrt(30e0)) / 36), (2, -sqrt(3e0 / 7 - 2e0 / 7 * sqrt(12e-1)), (18 + sqrt(30e0)) / 36), (3, -sqrt(3e0 / 7 + 2e0 / 7 * sqrt(12e-1)), (18 - sqrt(30e0)) / 36)) SELECT CAST(i_lat * 8 + k AS BIGINT) AS point_id, i_lat, CAST(k AS INT) AS i_lon, round(-pi() + pi() / 8 + k * pi() / 4, 11) AS lon, round(asin(x), 11) AS lat, round(w * pi() / 4, 11) AS area FROM r, range(8) t(k)")
def gen06_gauss_grid(spark, sf):
    return rounded(grids.gauss_grid(spark, 4), lon=11, lat=11, area=11)


@query("WITH l AS (SELECT CAST(k AS INT) AS i_lat, k * pi() / 30 AS th, cos(pi() / 30) AS c, sin(pi() / 60) AS s FROM range(31) t(k)), n AS (SELECT *, CASE WHEN i_lat IN (0, 30) THEN 1 ELSE CAST(floor(2 * pi() / acos((c - cos(th) * cos(th)) / (sin(th) * sin(th)))) AS INT) END AS cnt FROM l), p AS (SELECT n.*, unnest(generate_series(0, cnt - 1)) AS i FROM n) SELECT i_lat, CAST(i AS INT) AS i_lon, round(CASE WHEN i_lat IN (0, 30) THEN 0 ELSE ((i + 15e-1) * 2 * pi() / cnt + pi()) - 2 * pi() * floor(((i + 15e-1) * 2 * pi() / cnt + pi()) / (2 * pi())) - pi() END, 9) AS lon, round(atan2(sin(pi() / 2 - th), (1 - 1 / 298.257222101e0) * (1 - 1 / 298.257222101e0) * cos(pi() / 2 - th)), 9) AS lat, round(CASE WHEN i_lat IN (0, 30) THEN 2 * pi() * (1 - cos(pi() / 60)) ELSE 4 * pi() / cnt * s * sin(th) END, 9) AS area FROM p")
def gen07_reuter_grid(spark, sf):
    return rounded(grids.reuter_grid(spark, 30), lon=9, lat=9, area=9)


@query()
def gen08_geodesic_grid(spark, sf):
    return grids.geodesic_grid(spark, 8)


@query("WITH p AS (SELECT k AS point_id, k * pi() / 2 / 49 AS psi, atan2((1 - 1 / 298.257222101e0) * (1 - 1 / 298.257222101e0) * sin(5e-1), cos(5e-1)) AS b FROM range(50) t(k)), q AS (SELECT *, sin(b) * cos(psi) + cos(b) * sin(psi) * cos(1e0) AS z, atan2(sin(1e0) * sin(psi) * cos(b), cos(psi) - sin(b) * (sin(b) * cos(psi) + cos(b) * sin(psi) * cos(1e0))) AS dl FROM p) SELECT point_id, round(psi, 10) AS psi, round(2e-1 + dl, 9) AS lon, round(atan2(z, (1 - 1 / 298.257222101e0) * (1 - 1 / 298.257222101e0) * sqrt(1 - z * z)), 9) AS lat FROM q")
def gen10_great_circle(spark, sf):
    return rounded(grids.great_circle(spark, 0.2, 0.5, 1.0, 50, math.pi / 2), psi=10, lon=9, lat=9)


@query("SELECT CAST(k AS BIGINT) AS point_id, round(radians(-180e0 + 30 * (k % 12)), 10) AS west, round(radians(-150e0 + 30 * (k % 12)), 10) AS east, round(radians(60e0 - 30 * (k // 12)), 10) AS south, round(radians(90e0 - 30 * (k // 12)), 10) AS north FROM range(72) t(k)")
def gen15_rectangles(spark, sf):
    cells = grids.rectangles(grids.geographic_grid(spark, 30.0, 30.0)).select("point_id", "west", "east", "south", "north")
    return rounded(cells, west=10, east=10, south=10, north=10)


@query("SELECT false AS compatible")
def join12_compatible(spark, sf):
    points = rel.points(spark, sf)
    return grids.compatible(points, points.withColumn("lat", F.when(F.col("point_id") == 3, 0.9).otherwise(F.col("lat"))))


@query("SELECT CAST(k AS BIGINT) AS point_id, CAST(k // 12 AS INT) AS i_lat, CAST(k % 12 AS INT) AS i_lon FROM range(72) t(k)")
def prj15_to_regular(spark, sf):
    scattered = grids.geographic_grid(spark, 30.0, 30.0).select("point_id", (F.col("lon") + F.col("point_id") * 1e-10).alias("lon"), (F.col("lat") - F.col("point_id") * 1e-10).alias("lat"))
    return grids.regularised(scattered).select("point_id", "i_lat", "i_lon")


@query(f"WITH {POINT}, {OTHER}, t AS (SELECT point_id AS target_id, lon AS lon2, lat AS lat2 FROM f_point), d AS (SELECT point_id, target_id, value, sin(lat) * sin(lat2) + cos(lat) * cos(lat2) * cos(lon2 - lon) AS c FROM f_other, t), b AS (SELECT point_id, arg_max(target_id, c) AS target_id, any_value(value) AS value FROM d GROUP BY 1) SELECT target_id, count(*) AS n, round(avg(value), 6) AS mean FROM b GROUP BY 1 HAVING count(*) >= 1")
def agg09_nearest_cells(spark, sf):
    """The customers in the cell of each supplier."""
    return rounded(grids.cells_of(rel.points(spark, sf, "customer"), rel.points(spark, sf)), mean=6)


@query(f"WITH {POINT} SELECT a.point_id, b.point_id AS target_id, round(acos(greatest(-1, least(1, sin(a.lat) * sin(b.lat) + cos(a.lat) * cos(b.lat) * cos(b.lon - a.lon)))), 6) AS psi FROM f_point a, f_point b WHERE a.point_id <> b.point_id")
def join10_distances(spark, sf):
    points = rel.points(spark, sf)
    pairs = grids.distances(points, points).where("point_id <> target_id")
    return pairs.withColumn("psi", F.floor(F.col("psi") * 1e6 + 0.5) / 1e6)  # as round does where nothing is negative, without its decimals: rows are many
