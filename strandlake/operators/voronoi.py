"""Voronoi cell areas: half-planes of nearby points, a block of the plane at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import iterate
from ..plans.kernels import groups
from .spatial import _cells, _offsets, bounding_box

#: most points in a square of the first reach, sides of a block in reaches, and neighbours tried at first
CROWD, BLOCK, NEAR = 96, 4, 24
#: rows of which one task takes a hull, and open cells that are no longer searched in steps
HULL_ROWS, FEW = 50_000, 2000


def clip(polygon: np.ndarray, nx: float, ny: float, d: float) -> np.ndarray:
    """The part of a convex polygon where nx x + ny y <= d."""
    s = polygon @ np.array([nx, ny]) - d
    if (s <= 0).all():
        return polygon
    out = []
    for i in range(len(polygon)):
        j = (i + 1) % len(polygon)
        if s[i] <= 0:
            out.append(polygon[i])
        if (s[i] <= 0) != (s[j] <= 0):
            out.append(polygon[i] + (polygon[j] - polygon[i]) * (s[i] / (s[i] - s[j])))
    return np.array(out).reshape(-1, 2)


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the points on the boundary of the convex hull, those between its corners included."""
    order = np.lexsort((y, x))
    out: set[int] = set()
    for way in (order, order[::-1]):
        chain: list[int] = []
        for i in way.tolist():
            while len(chain) > 1 and (x[chain[-1]] - x[chain[-2]]) * (y[i] - y[chain[-2]]) - (y[chain[-1]] - y[chain[-2]]) * (x[i] - x[chain[-2]]) < 0:
                chain.pop()
            chain.append(i)
        out |= set(chain)
    return np.array(sorted(out), np.int64)


def on_hull(points: DataFrame) -> DataFrame:
    """(run_id, id) of the points on their run's convex hull, by a reduction tree: hulls of parts, of groups of what these
    leave, and so on while that sheds rows; a run's hull itself (the result) is one task's at the end."""
    schema = "run_id long, id long, x double, y double"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["run_id"]):
            yield from t.take(pa.array(hull(t["x"].to_numpy(), t["y"].to_numpy()))).combine_chunks().to_batches()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch is a part
            yield from kept(iter([b.take(pc.sort_indices(b, [("run_id", "ascending")]))]))

    count = {"n": F.count("*")}
    some, before = iterate.cut(points.select("run_id", "id", "x", "y").mapInArrow(parts, schema), "hull", count), None
    while some.seen["n"] > HULL_ROWS and (before is None or some.seen["n"] < 0.7 * before):
        before, groups_ = some.seen["n"], -(-some.seen["n"] // HULL_ROWS)
        mixed = some.repartition(groups_, F.xxhash64("id") % groups_).sortWithinPartitions("run_id")
        new = iterate.cut(mixed.mapInArrow(kept, schema), "hull", count)
        iterate.drop(some)
        some = new
    return some.repartition("run_id").sortWithinPartitions("run_id").mapInArrow(kept, schema).select("run_id", "id")


def clipped(dx: np.ndarray, dy: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(area, largest distance of a corner) of the cells around the origin, one for every row of neighbours, within a
    square of half side `size`.

    Every neighbour's bisector is cut by all others to the interval that borders the cell; the triangles between these
    intervals and the origin make up the area.
    """
    away = np.hypot(dx, dy)
    box = np.broadcast_to(np.array([[1.0, 0, -1, 0], [0, 1, 0, -1]])[:, None], (2, len(dx), 4))
    nx, ny = np.concatenate((dx / away, box[0]), 1), np.concatenate((dy / away, box[1]), 1)
    d = np.concatenate((away / 2, np.full((len(dx), 4), size)), 1)
    # along bisector j the place t fulfils bisector i if t * cross <= rest
    cross = nx[:, :, None] * ny[:, None, :] - ny[:, :, None] * nx[:, None, :]
    rest = d[:, None, :] - d[:, :, None] * (nx[:, :, None] * nx[:, None, :] + ny[:, :, None] * ny[:, None, :])
    same = np.arange(d.shape[1])
    cross[:, same, same] = rest[:, same, same] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        t = rest / cross
    hi = np.where(cross > 0, t, np.inf).min(2)
    lo = np.where(cross < 0, t, -np.inf).max(2)
    borders = (hi > lo) & ~((cross == 0) & (rest < 0)).any(2)
    area = np.where(borders, d * (hi - lo) / 2, 0).sum(1)
    return area, np.where(borders, np.hypot(d, np.maximum(np.abs(lo), np.abs(hi))), 0).max(1)


def settled_cell(qx: np.ndarray, qy: np.ndarray, poly: np.ndarray) -> tuple[float, float]:
    """(area, largest distance of a corner) of the cell around the origin among all points q, from a polygon that holds it:
    while a point is nearer to a corner than the origin is, the nearest one's bisector cuts the corner off."""
    q2, unused = qx * qx + qy * qy, np.ones(len(qx), bool)
    while True:
        nearer = np.where(unused[:, None], q2[:, None] - 2 * (qx[:, None] * poly[:, 0] + qy[:, None] * poly[:, 1]), np.inf)
        best = nearer.argmin(0)
        cuts = np.unique(best[nearer[best, np.arange(len(poly))] < 0])
        if not len(cuts):
            break
        unused[cuts] = False
        for i in cuts:
            poly = clip(poly, qx[i], qy[i], q2[i] / 2)
    nxt = np.roll(poly, -1, 0)
    return 0.5 * abs((poly[:, 0] * nxt[:, 1] - nxt[:, 0] * poly[:, 1]).sum()), float(np.hypot(*poly.T).max())


def cells_among(x: np.ndarray, y: np.ndarray, own: np.ndarray, reach: float, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, area, radius) of the points in `own` whose cells all points within reach settle (with `last`: all points).

    Cells are cut by their NEAR nearest neighbours first. Such a cell stands if its corners are within half the distance
    of the next point; the others, few, are cut on one by one.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    size = reach * (1e6 if last else 2)
    n = len(x) - 1
    k = min(NEAR, n)
    rows = max(1, min((1 << 21) // len(x), (1 << 21) // (k + 4) ** 2))
    for part in np.split(own, range(rows, len(own), rows)) if n else ():
        d2 = (x[part, None] - x) ** 2 + (y[part, None] - y) ** 2
        d2[np.arange(len(part)), part] = np.inf
        near = np.argpartition(d2, k, axis=1)[:, :k] if k < n else np.argsort(d2, axis=1)[:, :k]
        ahead = np.partition(d2, k, axis=1)[:, k] ** 0.5 if k < n else np.full(len(part), np.inf)
        area, radius = clipped(x[near] - x[part, None], y[near] - y[part, None], size)
        for i in np.flatnonzero((radius > ahead / 2) & (last | (ahead < reach))).tolist():
            others = np.delete(np.arange(len(x)), part[i])
            qx, qy = x[others] - x[part[i]], y[others] - y[part[i]]
            area[i], radius[i] = settled_cell(qx, qy, np.array([(-size, -size), (size, -size), (size, size), (-size, size)]))
        good = np.full(len(part), True) if last else radius <= reach / 2
        out.append((part[good], area[good], radius[good]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _first_reach(points: DataFrame, width: float, n: int) -> float:
    """Three mean spacings, halved until no square of that side holds over CROWD points."""
    reach = 3 * width / n**0.5
    while reach > 1e-12 * width:
        if (_cells(points, reach).groupBy("run_id", "cx", "cy").count().agg(F.max("count")).first()[0] or 0) <= CROWD:
            break
        reach /= 2
    return reach


def voronoi_areas(points: DataFrame) -> DataFrame:
    """(run_id, id, area) of bounded cells. Of several points at one place the smallest id counts; points without finite
    coordinates count nowhere.

    Points on the convex hull have unbounded cells and are set aside first. The plane is cut into blocks; a block gets its
    points and those within `reach` of them, and settles the cells whose corners lie within reach / 2. The reach begins where
    points are densest, and doubles for the cells left open. A settled cell of radius r borders only on points within 2r, so
    its point goes on to later rounds only if an open cell's point is that near: dense places drop out as the reach grows,
    and no block's points grow with the data. What is left at the end, at most FEW cells, is settled in one step.
    """
    finite = points.where("id is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    p = iterate.cut(finite.groupBy("run_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("id").cast("long").alias("id")), "voronoi", {"n": F.count("*")})
    b = bounding_box(p).agg(F.max(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))).first()[0] or 1.0
    reach = _first_reach(p, b, max(1, p.seen["n"]))
    edge = on_hull(p).withColumn("edge", F.lit(True))
    count = {"n": F.count("*"), "open": F.count_if("open")}
    active = iterate.cut(p.join(edge, ["run_id", "id"], "left").select("run_id", "id", "x", "y", F.col("edge").isNull().alias("open"), F.lit(None).cast("double").alias("radius")), "voronoi", count)
    iterate.drop(p)
    done = []
    while active.seen["open"]:
        last = reach > 2 * b or active.seen["open"] <= FEW and bool(done)
        reach = max(reach, 2.1 * b) if last else reach
        found = iterate.cut(_settled(active, reach, last), "cells")
        done.append(found.select("run_id", "id", "area"))
        if last:
            break
        new = iterate.cut(_still_active(active, found), "voronoi", count)
        iterate.drop(active)
        active, reach = new, 2 * reach
    iterate.drop(active)
    empty = points.sparkSession.createDataFrame([], "run_id long, id long, area double")
    out = done[0] if done else empty
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _settled(active: DataFrame, reach: float, last: bool) -> DataFrame:
    """(run_id, id, area, radius) of open cells that points within reach settle."""
    side = F.lit(BLOCK * reach)
    h = F.least(F.lit(reach), F.coalesce(2 * F.col("radius"), F.lit(reach)))
    rows = active.withColumn("bx", F.explode(F.sequence(F.floor((F.col("x") - h) / side), F.floor((F.col("x") + h) / side))))
    rows = rows.withColumn("by", F.explode(F.sequence(F.floor((F.col("y") - h) / side), F.floor((F.col("y") + h) / side))))
    own = F.col("open") & (F.col("bx") == F.floor(F.col("x") / side)) & (F.col("by") == F.floor(F.col("y") / side))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["run_id", "bx", "by"]):
            mine = np.flatnonzero(t["own"].to_numpy())
            if len(mine):
                i, area, radius = cells_among(t["x"].to_numpy(), t["y"].to_numpy(), mine, reach, last)
                ids = t.select(["run_id", "id"]).take(pa.array(i)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(ids[c].combine_chunks() for c in ("run_id", "id")), pa.array(area), pa.array(radius)], names=["run_id", "id", "area", "radius"])

    dealt = rows.select("run_id", "bx", "by", "id", "x", "y", own.alias("own"))
    parts = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "run_id", "bx", "by").sortWithinPartitions("run_id", "bx", "by", "id")
    return dealt.mapInArrow(settle, "run_id long, id long, area double, radius double")


def _still_active(active: DataFrame, found: DataFrame) -> DataFrame:
    """active after a round: open cells, the hull, and settled cells near whose points an open one's lies."""
    now = active.withColumnRenamed("radius", "before").join(found.select("run_id", "id", "radius"), ["run_id", "id"], "left")
    now = iterate.cut(now.select("run_id", "id", "x", "y", (F.col("open") & F.col("radius").isNull()).alias("open"), F.coalesce("before", "radius").alias("radius")), "voronoi")
    level = F.ceil(F.log2(2 * F.col("radius"))).cast("int")
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    settled = now.where("radius is not null").withColumn("level", level).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    low, high = settled.agg(F.min("level"), F.max("level")).first()
    around = now.where("open").select("run_id", "x", "y", F.explode(F.sequence(F.lit(low or 0), F.lit(high or 0))).alias("level"))
    around = around.select("run_id", "level", cell("x").alias("x"), cell("y").alias("y")).distinct()
    around = around.select("run_id", "level", "x", "y", _offsets([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]).alias("o"))
    around = around.select("run_id", "level", (F.col("x") + F.col("o.dx")).alias("cx"), (F.col("y") + F.col("o.dy")).alias("cy"))
    near = settled.join(around, ["run_id", "level", "cx", "cy"], "left_semi").select(*now.columns)
    return now.where("radius is null").unionByName(near)
