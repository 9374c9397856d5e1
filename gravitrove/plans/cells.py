"""Queries over neighbours and Voronoi cells of scattered points, and their SQL: every triple of points against all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import voronoi
from . import relations as rel
from .queries import POINT
from .registry import query, rounded

AUTHALIC = "asin((sin(lat) / (1 - e2 * sin(lat) * sin(lat)) + ln((1 + sqrt(e2) * sin(lat)) / (1 - sqrt(e2) * sin(lat))) / (2 * sqrt(e2))) / (1 / (1 - e2) + ln((1 + sqrt(e2)) / (1 - sqrt(e2))) / (2 * sqrt(e2))))"


def _triangles(lat: str) -> str:
    """Corners counter-clockwise, with the centre of their empty cap."""
    inner = "t.nx * (s.x - t.ax) + t.ny * (s.y - t.ay) + t.nz * (s.z - t.az)"
    return f"""v AS (SELECT point_id, lon, lat, cos(b) * cos(lon) AS x, cos(b) * sin(lon) AS y, sin(b) AS z FROM (SELECT *, {lat} AS b FROM f_point, (SELECT 2e0 / 298.257222101e0 - 1e0 / (298.257222101e0 * 298.257222101e0) AS e2) e) w),
t AS (SELECT a.point_id AS a, b.point_id AS b, c.point_id AS c, a.x AS ax, a.y AS ay, a.z AS az,
  (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
  FROM v a JOIN v b ON a.point_id < b.point_id JOIN v c ON b.point_id < c.point_id),
side AS (SELECT a, b, c, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, max({inner}) AS most, min({inner}) AS least
  FROM t JOIN v s ON s.point_id NOT IN (a, b, c) GROUP BY a, b, c),
tri AS (SELECT a, CASE WHEN most <= 0 THEN b ELSE c END AS b, CASE WHEN most <= 0 THEN c ELSE b END AS c, CASE WHEN most <= 0 THEN 1 ELSE -1 END / sqrt(nx * nx + ny * ny + nz * nz) AS k, nx, ny, nz FROM side WHERE most <= 0 OR least >= 0),
turned AS (SELECT a AS p, b AS q, c AS r, k * nx AS cx, k * ny AS cy, k * nz AS cz FROM tri UNION ALL SELECT b, c, a, k * nx, k * ny, k * nz FROM tri UNION ALL SELECT c, a, b, k * nx, k * ny, k * nz FROM tri)"""


def _solid(a: str, b: str, c: str) -> str:
    dot = lambda u, v: f"({u}x * {v}x + {u}y * {v}y + {u}z * {v}z)"
    volume = f"({a}x * ({b}y * {c}z - {b}z * {c}y) + {a}y * ({b}z * {c}x - {b}x * {c}z) + {a}z * ({b}x * {c}y - {b}y * {c}x))"
    return f"2 * atan2({volume}, 1 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)})"


def _middle(name: str, other: str) -> str:
    length = f"sqrt(pow(p.x + {other}.x, 2) + pow(p.y + {other}.y, 2) + pow(p.z + {other}.z, 2))"
    return ", ".join(f"(p.{c} + {other}.{c}) / {length} AS {name}{c}" for c in "xyz")


@query(f"""WITH {POINT}, {_triangles('lat')}, one AS (SELECT DISTINCT p, q FROM turned), two AS (SELECT p, q FROM one UNION SELECT a.p, b.q FROM one a JOIN one b ON a.q = b.p WHERE a.p <> b.q),
az AS (SELECT two.p AS point_id, two.q AS neighbour_id, one.p IS NOT NULL AS adjacent, atan2(sin(o.lon - h.lon) * cos(o.lat), cos(h.lat) * sin(o.lat) - sin(h.lat) * cos(o.lat) * cos(o.lon - h.lon)) AS az
  FROM two LEFT JOIN one ON one.p = two.p AND one.q = two.q JOIN f_point h ON h.point_id = two.p JOIN f_point o ON o.point_id = two.q)
SELECT point_id, neighbour_id, adjacent, round(CASE WHEN az < 0 THEN az + 2 * pi() ELSE az END, 7) AS azimuth FROM az""")
def join11_point_neighbours(spark, sf):
    """Suppliers at most two Voronoi cells apart."""
    found = voronoi.neighbours(rel.points(spark, sf), 2)
    return rounded(found.select("point_id", "neighbour_id", (F.col("level") == 1).alias("adjacent"), "azimuth"), azimuth=7)


@query(f"""WITH {POINT}, {_triangles(AUTHALIC)}, h AS (SELECT p.point_id, p.x AS px, p.y AS py, p.z AS pz, cx, cy, cz, {_middle('m', 'q')}, {_middle('n', 'r')} FROM turned JOIN v p ON p.point_id = turned.p JOIN v q ON q.point_id = turned.q JOIN v r ON r.point_id = turned.r)
SELECT point_id, count(*) AS corners, round(sum({_solid('p', 'm', 'c')} + {_solid('p', 'c', 'n')}), 9) AS area FROM h GROUP BY 1""")
def gen16_voronoi_cells(spark, sf):
    """Corners and areas of the suppliers' cells."""
    points = rel.points(spark, sf)
    corners = voronoi.voronoi_cells(points).groupBy("point_id").agg(F.count("*").alias("corners"))
    return rounded(corners.join(voronoi.voronoi_areas(points), "point_id"), area=9)
