"""Neighbours and Voronoi cells of scattered points on the sphere.

The triangles about a point are the edges of a plane convex hull: seen in the stereographic projection from the point, the
circles through it are lines, and a cap without points lies beyond a line without points. So each point finds its own
triangles, among the points of its cube of space and those next to it. A triangle whose cap lies within what the cubes
hold is final. Points with other triangles go on with edges twice as long, where they meet only each other, since
every corner of a wide empty cap is such a point, and their own neighbours so far.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import FLATTENING, authalic_to_geodetic, geodetic_to_authalic
from .storage import stored

#: Points of a cube at most, in the first round.
CUBE = 512
STAR = "point_id long, x double, y double, z double, open boolean, star array<struct<id:long,x:double,y:double,z:double,cx:double,cy:double,cz:double>>"
#: Points whose direction differs less, in radians, are on one line.
ON_LINE = 1e-12
#: Points whose stars one task forms, and candidates with which a star begins.
TASK, FIRST = 1024, 24


def _star(p: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in others of the neighbours of p, and the centres of the caps: the hull of a few, then of those that lie in its caps, too."""
    apart = others - p
    few = np.argsort((apart**2).sum(axis=1))[:FIRST] if len(others) > FIRST else np.arange(len(others))
    while True:
        corners = few[_hull(p, others[few])]
        centres = _caps(p, others[corners])
        depth = apart @ centres.T
        depth[few] = 0
        worst = np.argmax(depth, axis=0)
        more = np.unique(worst[depth[worst, np.arange(len(worst))] > 1e-15])
        if not len(more):
            return corners, centres
        few = np.concatenate([corners, more])


def _hull(p: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The places in others of the hull's corners about p, counter-clockwise seen from outside; points on an edge are none."""
    axis = np.eye(3)[np.argmin(np.abs(p))]
    east = np.cross(axis, p)
    east /= np.linalg.norm(east)
    apart = others - p
    u = 2 * (apart @ np.column_stack([east, np.cross(p, east)])) / (apart**2).sum(axis=1, keepdims=True)
    first = here = int(np.argmax((u**2).sum(axis=1)))
    ahead, corners = np.array([-u[first, 1], u[first, 0]]), [first]
    while len(corners) <= len(u):
        step = u - u[here]
        along, aside = step @ ahead, ahead[0] * step[:, 1] - ahead[1] * step[:, 0]
        size = np.hypot(along, aside)
        angle = np.arctan2(aside, along)
        angle[angle < -ON_LINE] += 2 * math.pi
        angle[here] = np.inf
        near = np.flatnonzero(angle <= angle.min() + ON_LINE)
        here = int(near[np.argmax(size[near])])
        if here == first:
            break
        corners.append(here)
        ahead = u[here] - u[corners[-2]]
        ahead /= np.linalg.norm(ahead)
    return np.array(corners)


def _caps(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The centres of the caps through p and each corner and the next; with one corner none."""
    if len(corners) < 2:
        return np.full((len(corners), 3), np.nan)
    normal = np.cross(corners - p, np.roll(corners, -1, axis=0) - p)
    return normal / np.linalg.norm(normal, axis=1, keepdims=True)


def _stars(edge: float, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, place = rows["point_id"].to_numpy(), rows[["x", "y", "z"]].to_numpy()
        out = []
        for k in np.flatnonzero(rows["own"].to_numpy()):
            p, kept, met = place[k], np.ones(len(ids), bool), rows["star"].iloc[k]
            kept[k] = False
            held = {int(s["id"]): (s["x"], s["y"], s["z"]) for s in (met if met is not None else []) if not np.isin(s["id"], ids)}
            names = np.concatenate([ids[kept], np.array(list(held), np.int64)])
            others = np.vstack([place[kept], np.array(list(held.values())).reshape(-1, 3)])
            corners, centres = _star(p, others) if len(names) else (np.zeros(0, int), np.zeros((0, 3)))
            # the cap's farthest point from p is at twice its radius; a cap beyond a half sphere reaches everywhere
            cosine = np.clip(centres @ p, -1, 1)
            reach = np.where(cosine > 0, 2 * np.sqrt(1 - cosine**2), 2.0)
            final = last or (len(corners) > 2 and bool((reach <= edge).all()))
            star = [dict(zip(("id", "x", "y", "z", "cx", "cy", "cz"), (int(names[c]), *map(float, others[c]), *map(float, m)))) for c, m in zip(corners, centres)]
            out.append((int(ids[k]), *map(float, p), not final, star))
        return pd.DataFrame(out, columns=["point_id", "x", "y", "z", "open", "star"])

    return run


def _cubes(rows: DataFrame, edge: float, reach: int) -> DataFrame:
    for name in "xyz":
        cube = F.floor(F.col(name) / edge)
        rows = rows.withColumn(f"k{name}", F.explode(F.sequence(cube - reach, cube + reach)) if reach else cube)
    return rows


def stars(points: DataFrame) -> DataFrame:
    """Rows (point_id, x, y, z, star): each point's neighbours, counter-clockwise, with the centre of the empty cap up to the next one.

    points: rows (point_id, lon, lat) on a sphere. Points in one place count as one, under the smallest id. Neighbours share an
    edge of their Voronoi cells; points that only meet at a corner, as across a square, are none.
    """
    place = {"x": F.cos("lat") * F.cos("lon"), "y": F.cos("lat") * F.sin("lon"), "z": F.sin("lat")}
    rows = points.where("lon is not null and lat is not null").select("point_id", *[F.round(v, 13).alias(c) for c, v in place.items()])
    rows = stored(rows.groupBy("x", "y", "z").agg(F.min("point_id").cast("long").alias("point_id")))
    count = rows.count()
    edge = min(2.0, math.sqrt(16 * math.pi / max(count, 1)))
    while count > CUBE and edge > 1e-12 and _cubes(rows, edge, 0).groupBy("kx", "ky", "kz").count().agg(F.max("count")).first()[0] > CUBE:
        edge /= 2
    open_ = rows.withColumn("star", F.lit(None).cast(STAR.split("star ")[1]))
    done = []
    while True:
        last = edge >= 2
        here = _cubes(open_, edge, 0)
        tasks = here.groupBy("kx", "ky", "kz").agg(F.ceil(F.count("*") / TASK).alias("tasks"))
        near = _cubes(open_.drop("star"), edge, 1).join(here.select("kx", "ky", "kz").distinct(), ["kx", "ky", "kz"], "left_semi")
        near = near.join(tasks, ["kx", "ky", "kz"]).withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
        near = near.join(here.select("point_id", "kx", "ky", "kz", "star", F.lit(True).alias("home")), ["point_id", "kx", "ky", "kz"], "left")
        own = F.coalesce("home", F.lit(False)) & (F.pmod(F.xxhash64("point_id"), F.col("tasks")) == F.col("task"))
        found = stored(near.withColumn("own", own).drop("home").groupBy("kx", "ky", "kz", "task").applyInPandas(_stars(edge, last), STAR))
        done.append(found.where("not open").drop("open"))
        open_ = found.where("open").drop("open")
        if last or open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        edge = min(2.0, 2 * edge)


def neighbours(points: DataFrame, level: int = 1) -> DataFrame:
    """Rows (point_id, neighbour_id, level, azimuth): the points at most `level` Voronoi cells away, and how many; azimuth clockwise from north.

    Each further level is a join of the pairs so far with the neighbours of their ends.
    """
    if level < 1:
        raise ValueError("the level is at least 1")
    pairs = stored(stars(points).select("point_id", F.explode("star.id").alias("neighbour_id")))
    next_, reached = pairs.select(F.col("point_id").alias("neighbour_id"), F.col("neighbour_id").alias("further")), pairs.withColumn("level", F.lit(1))
    for k in range(1, level):
        more = reached.where(F.col("level") == k).join(next_, "neighbour_id").where("point_id != further").select("point_id", F.col("further").alias("neighbour_id"), F.lit(k + 1).alias("level"))
        reached = reached.unionByName(more).groupBy("point_id", "neighbour_id").agg(F.min("level").alias("level"))
    at = points.select("point_id", "lon", "lat")
    other = at.select(F.col("point_id").alias("neighbour_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    turn = F.col("lon2") - F.col("lon")
    azimuth = F.atan2(F.sin(turn) * F.cos("lat2"), F.cos("lat") * F.sin("lat2") - F.sin("lat") * F.cos("lat2") * F.cos(turn))
    return reached.join(at, "point_id").join(other, "neighbour_id").select("point_id", "neighbour_id", "level", F.pmod(azimuth, F.lit(2 * math.pi)).alias("azimuth"))


def voronoi_cells(points: DataFrame, f: float = FLATTENING) -> DataFrame:
    """Rows (point_id, seq, lon, lat): the corners of the cell of each point, counter-clockwise; lon, lat geodetic.

    Cells are formed on the authalic sphere, so that their areas are those on the ellipsoid. Corners are the centres of
    empty caps. Of fewer than three points, none have corners.
    """
    on_sphere = points.withColumn("lat", geodetic_to_authalic("lat", f))
    corners = stars(on_sphere).select("point_id", F.posexplode("star").alias("seq", "s")).where("s.cx is not null and not isnan(s.cx)")
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s.cz"))))
    return corners.select("point_id", "seq", F.atan2("s.cy", "s.cx").alias("lon"), authalic_to_geodetic(lat, f).alias("lat"))


def _solid(a, b, c) -> Column:
    """Signed area of the triangle of three columns of unit vectors (as tuples of columns)."""
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    volume = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return 2 * F.atan2(volume, 1 + dot(a, b) + dot(b, c) + dot(c, a))


def voronoi_areas(points: DataFrame, f: float = FLATTENING) -> DataFrame:
    """Rows (point_id, area): the cells' areas on the unit sphere, which is the ellipsoid's where scaled by its authalic radius."""
    on_sphere = points.withColumn("lat", geodetic_to_authalic("lat", f))
    size = F.size("star")
    here = stars(on_sphere).where(size > 1)
    p = tuple(F.col(c) for c in "xyz")
    at = lambda s: (s["cx"], s["cy"], s["cz"])
    half = lambda s: tuple((p[k] + s[c]) / F.sqrt((p[0] + s["x"]) ** 2 + (p[1] + s["y"]) ** 2 + (p[2] + s["z"]) ** 2) for k, c in enumerate("xyz"))
    # of each neighbour: from the centre before it to the middle of the way to it, and on to the centre after it
    parts = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(F.col("star")[F.pmod(k - 1, size)].alias("before"), F.col("star")[k].alias("here")))
    area = F.aggregate(parts, F.lit(0.0), lambda total, s: total + _solid(p, at(s["before"]), half(s["here"])) + _solid(p, half(s["here"]), at(s["here"])))
    return here.select("point_id", area.alias("area"))
