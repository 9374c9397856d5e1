"""Queries that write tables in the formats of the readers, into the shared folder, and read them back; and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators.storage import shared_folder
from ..sources import fields, grids, mascons, series
from . import relations as rel
from .queries import COEF, MAT, OTHER, POINT
from .registry import query, rounded
from .systems import SMALL, _systems


def _written(spark, lines) -> str:
    """A folder of text files of rows (k, value), each file in the order of k."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    lines.repartitionByRange(4, "k").sortWithinPartitions("k").select("value").write.text(path)
    return path


def _pairs(spark, sf):
    """Rows (epoch, n, m, c, s) of the monthly fields."""
    c, s = (F.coalesce(F.sum(F.when(F.col("trig") == t, F.col("value"))), F.lit(0.0)) for t in (0, 1))
    return rel.coefficients(spark, sf).groupBy("epoch", "n", "m").agg(c.alias("c"), s.alias("s"))


PAIRS = f"{COEF}, pairs AS (SELECT epoch, n, m, coalesce(sum(CASE WHEN trig = 0 THEN value END), 0e0) AS c, coalesce(sum(CASE WHEN trig = 1 THEN value END), 0e0) AS s FROM f_coef GROUP BY 1, 2, 3)"


@query(f"WITH {PAIRS}, mean AS (SELECT n, m, avg(c) AS c, avg(s) AS s FROM pairs GROUP BY 1, 2) SELECT n, m, 0 AS trig, round(c, 15) AS value FROM mean UNION ALL SELECT n, m, 1, round(s, 15) FROM mean WHERE m > 0")
def src01_src02_mean_field_as_gfc(spark, sf):
    """The mean field as text, compressed, and back."""
    mean = _pairs(spark, sf).groupBy("n", "m").agg(F.avg("c").alias("c"), F.avg("s").alias("s"))
    lines = mean.select((F.col("n") * 1000 + F.col("m")).alias("k"), F.format_string("gfc %4d %4d %.17e %.17e 0.0 0.0", "n", "m", "c", "s").alias("value"))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    lines.repartitionByRange(4, "k").sortWithinPartitions("k").select("value").write.option("compression", "gzip").text(path)
    return rounded(fields.read_gfc(spark, path).select("n", "m", "trig", "value"), value=15)


@query(f"WITH {PAIRS}, last AS (SELECT n, m, arg_max(c, epoch) AS c, arg_max(s, epoch) AS s FROM pairs GROUP BY 1, 2) SELECT n, m, 0 AS trig, round(c, 15) AS value FROM last UNION ALL SELECT n, m, 1, round(s, 15) FROM last WHERE m > 0")
def src06_latest_coefficients_as_grcof2(spark, sf):
    """Of each coefficient the latest month's, as rows of a monthly solution."""
    last = _pairs(spark, sf).groupBy("n", "m").agg(F.max_by("c", "epoch").alias("c"), F.max_by("s", "epoch").alias("s"))
    lines = last.select((F.col("n") * 1000 + F.col("m")).alias("k"), F.regexp_replace(F.format_string("GRCOF2 %4d %4d %.17e %.17e", "n", "m", "c", "s"), "e([-+])", "D$1").alias("value"))
    return rounded(fields.read_grcof2(spark, _written(spark, lines)).select("n", "m", "trig", "value"), value=15)


@query(f"WITH {PAIRS} SELECT CAST(epoch + INTERVAL 15 DAY AS TIMESTAMP) AS epoch, n, m, 0 AS trig, round(c, 15) AS value FROM pairs WHERE n = 1 UNION ALL SELECT CAST(epoch + INTERVAL 15 DAY AS TIMESTAMP), n, m, 1, round(s, 15) FROM pairs WHERE n = 1 AND m > 0")
def src03_geocentre_series(spark, sf):
    """The coefficients of degree 1, each over thirty days from its month's first."""
    day = lambda d: F.date_format(F.date_add("epoch", d), "yyyyMMdd.HHmm")
    rows = _pairs(spark, sf).where("n = 1")
    lines = rows.select(F.concat(F.col("epoch").cast("string"), F.col("m").cast("string")).alias("k"), F.format_string("GRCOF2 %4d %4d %.17e %.17e 0.0 0.0 %s %s", "n", "m", "c", "s", day(0), day(30)).alias("value"))
    return rounded(series.read_geocentre(spark, _written(spark, lines)).select("epoch", "n", "m", "trig", "value"), value=15)


@query(f"WITH {COEF} SELECT CAST(epoch + INTERVAL 10 DAY AS TIMESTAMP) AS epoch, n, m, trig, round(value, 15) AS value FROM f_coef WHERE (n = 2 OR n = 3) AND m = 0 AND epoch IN (SELECT epoch FROM f_coef WHERE n = 2 AND m = 0)")
def src04_low_zonals_series(spark, sf):
    """C20 and C30 of the months that have C20, in days; a month without C30 has NaN there. Each file begins with the heading."""
    rows = rel.coefficients(spark, sf).where("n in (2, 3) and m = 0").groupBy("epoch").agg(*[F.max(F.when(F.col("n") == n, F.col("value"))).alias(f"c{n}") for n in (2, 3)]).where("c2 is not null")
    days = F.datediff("epoch", F.lit("1858-11-17").cast("date"))
    third = F.coalesce(F.format_string("%.17e", "c3"), F.lit("NaN"))
    lines = rows.select(days.alias("k"), F.format_string("%.1f 2000.0 %.17e 1.0 0.5 %s 1.0 0.5 %.1f 2000.0", days.cast("double"), "c2", third, (days + 20).cast("double")).alias("value"))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    whole = spark.createDataFrame([(-2, "a heading"), (-1, "Product:")], "k int, value string").unionByName(lines)
    whole.repartition(1).sortWithinPartitions("k").select("value").write.text(path)  # one file: a series has one heading
    return rounded(series.read_low_zonals(spark, path).select("epoch", "n", "m", "trig", "value"), value=15)


@query(f"WITH {SMALL} SELECT 'matrix' AS part, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) AS v FROM nn WHERE sys_id = 0 UNION ALL SELECT 'vector', CAST(i AS BIGINT), CAST(-1 AS BIGINT), round(rhs, 6) FROM rr WHERE sys_id = 0 UNION ALL SELECT 'obs', 0, 0, count(*) FROM obs WHERE i % 4 = 0 UNION ALL SELECT 'lpl', 0, 0, round(sum(l * l), 6) FROM obs WHERE i % 4 = 0")
def src07_src09_src10_src11_src14_normals_as_sinex(spark, sf):
    """The first of the systems in a SINEX file and back: matrix, right side and statistics."""
    normal, right, stats = (x.where("sys_id = 0") for x in _systems(spark, sf))
    place = rel.unpacked(right.select("i", F.col("rhs").alias("value")), "i").select("i", "n", "m", "trig", "value")
    numbers = stats.select("obs", "lpl").first()
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    series.write_sinex(path, place, normal.select("i", "j", "v"), {"obs": float(numbers.obs), "parameters": 63.0, "lpl": float(numbers.lpl)})
    matrix, vector, held = series.sinex_normals(spark, path)
    rows = matrix.select(F.lit("matrix").alias("part"), "i", "j", "v").unionByName(vector.select(F.lit("vector").alias("part"), "i", F.lit(-1).cast("long").alias("j"), F.col("rhs").alias("v")))
    zero = F.lit(0).cast("long")
    for name in ("obs", "lpl"):
        rows = rows.unionByName(held.select(F.lit(name).alias("part"), zero.alias("i"), zero.alias("j"), F.col(name).alias("v")))
    return rounded(rows, v=6)


@query(f"WITH {POINT} SELECT point_id, round(lon, 12) AS lon, round(lat, 12) AS lat, value FROM f_point")
def src18_src19_saved_grid(spark, sf):
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    grids.save_grid(rel.points(spark, sf), path)
    return rounded(grids.load_grid(spark, path), lon=12, lat=12)


def _staged(df) -> str:
    path = f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


GRIDDED = "g AS (SELECT CAST(floor(user_id % 10) AS INT) AS step, 15e0 + 30 * (user_id % 12) AS lon, -75e0 + 30 * (event_id % 6) AS lat, sum(value) AS lwe FROM events GROUP BY 1, 2, 3)"


def _gridded(spark, sf) -> str:
    """Sums of events' values on a grid of 30 degrees, in steps of a day and a quarter, staged like a delivered file."""
    e = rel.table(spark, sf, "events")
    rows = e.groupBy((F.col("user_id") % 10).cast("int").alias("step"), (15.0 + 30 * (F.col("user_id") % 12)).alias("lon"), (-75.0 + 30 * (F.col("event_id") % 6)).alias("lat")).agg(F.sum("value").alias("lwe_thickness"))
    return _staged(rows.withColumn("time", 1.25 * F.col("step")).drop("step"))


@query(f"WITH {GRIDDED} SELECT TIMESTAMP '2002-01-01' + step * INTERVAL 30 HOUR AS epoch, round(radians(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END), 11) AS lon, round(radians(lat), 11) AS lat, round(lwe / 100, 8) AS value FROM g")
def src16_gridded_mascons(spark, sf):
    return rounded(mascons.read_mascon_grids(spark, _gridded(spark, sf)), lon=11, lat=11, value=8)


@query(f"WITH {POINT}, {GRIDDED}, c AS (SELECT DISTINCT lon, lat FROM g), d AS (SELECT p.point_id, c.lon, c.lat, sin(p.lat * 9e-1) * sin(radians(c.lat)) + cos(p.lat * 9e-1) * cos(radians(c.lat)) * cos(radians(c.lon) - p.lon * 99e-2) AS s FROM f_point p, c), b AS (SELECT point_id, arg_max(lon, s) AS lon, arg_max(lat, s) AS lat FROM d GROUP BY 1) SELECT TIMESTAMP '2002-01-01' + step * INTERVAL 30 HOUR AS epoch, point_id, round(lwe / 100, 8) AS value FROM b JOIN g USING (lon, lat)")
def src15_mascons_on_their_grid(spark, sf):
    """The suppliers, drawn off the poles and the meridian of 180 degrees, where cells are equally near, as the points on which the delivered grid was estimated."""
    points = rel.points(spark, sf).withColumns({"lat": 0.9 * F.col("lat"), "lon": 0.99 * F.col("lon")})
    return rounded(mascons.read_mascons_on_their_grid(spark, _gridded(spark, sf), points), value=8)


@query(f"WITH {OTHER}, a AS (SELECT point_id, 1e3 + value AS area FROM f_other), t AS (SELECT sum(area) AS total FROM a), s AS (SELECT c_custkey AS point_id, CAST(o_orderkey % 7 AS INT) AS step, sum(o_totalprice) AS x FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT TIMESTAMP '2002-01-01' + step * INTERVAL 12 HOUR AS epoch, CAST(s.point_id AS BIGINT) AS point_id, round(lon, 10) AS lon, round(lat, 10) AS lat, round(area / total * 4 * pi(), 10) AS area, round(x / 100, 4) AS value FROM s JOIN f_other o ON o.point_id = s.point_id JOIN a ON a.point_id = s.point_id, t")
def src17_mascon_solutions(spark, sf):
    """Customers as mascons, their orders' totals by a number of seven as the steps of the solution."""
    places = rel.points(spark, sf, "customer")
    staged = places.select(F.col("point_id").alias("mascon"), F.degrees("lon").alias("lon_center"), F.degrees("lat").alias("lat_center"), (1000 + F.col("value")).alias("area_km2"))
    orders = rel.table(spark, sf, "orders").join(places.select(F.col("point_id").alias("o_custkey")), "o_custkey")
    solution = orders.groupBy(F.col("o_custkey").cast("long").alias("mascon"), (F.col("o_orderkey") % 7).cast("int").alias("step")).agg(F.sum("o_totalprice").alias("cmwe"))
    times = spark.range(7).select(F.col("id").cast("int").alias("step"), (1 + F.col("id") / 2).alias("ref_days_middle"))
    points, values = mascons.read_mascon_solutions(spark, _staged(staged), _staged(times), _staged(solution))
    return rounded(values.join(points, "point_id").select("epoch", "point_id", "lon", "lat", "area", "value"), lon=10, lat=10, area=10, value=4)


@query(f"WITH {MAT} SELECT CAST(i % 13 AS INT) AS m, CAST(CASE WHEN i % 13 > 0 THEN i % 2 ELSE 0 END AS INT) AS trig, CAST(i + i % 13 AS BIGINT) AS i, CAST(j + i % 13 AS BIGINT) AS j, v FROM f_mat")
def src22_blocks_by_order(spark, sf):
    """The embeddings dealt into arrays of thirteen orders."""
    m = F.col("i") % 13
    name = F.concat(F.lit("order"), m.cast("string"), F.when((m > 0) & (F.col("i") % 2 == 1), "_sin").otherwise("_cos"))
    return mascons.read_order_blocks(spark, _staged(rel.matrix(spark, sf).select(name.alias("name"), F.col("i").alias("row"), F.col("j").alias("column"), F.col("v").alias("value"))))


@query(f"""WITH {POINT}, r AS (SELECT point_id, lon, CAST(floor((pi() / 2 - lat) / (pi() / 60) + 5e-1) AS INT) AS i_lat FROM f_point),
c AS (SELECT *, CASE WHEN i_lat IN (0, 60) THEN 1 ELSE CAST(floor(2 * pi() / acos((cos(pi() / 60) - pow(cos(i_lat * pi() / 60), 2)) / pow(sin(i_lat * pi() / 60), 2))) AS INT) END AS n FROM r),
f AS (SELECT *, lon / (2 * pi() / n) - 15e-1 + 5e-1 AS x FROM c)
SELECT i_lat, CAST(CASE WHEN n = 1 THEN 0 ELSE floor(x) - n * floor(floor(x) / n) END AS INT) AS i_lon, count(*) AS points FROM f GROUP BY 1, 2""")
def gen12_points_in_reuter_mascons(spark, sf):
    """How many suppliers lie in each of the rectangles; points and cells meet by rows of cells."""
    cells = mascons.reuter_mascons(spark)
    points = rel.points(spark, sf).withColumn("i_lat", F.floor((math.pi / 2 - F.col("lat")) / (math.pi / 60) + 0.5).cast("int")).select("i_lat", F.col("lon").alias("x"), "point_id")
    turned = F.pmod(F.col("x") - F.col("west"), F.lit(2 * math.pi))
    return cells.join(points, "i_lat").where(turned < F.col("east") - F.col("west")).groupBy("i_lat", "i_lon").agg(F.count("*").alias("points"))
