"""Spatial operators over points (run_id, id, x, y): contacts, neighbours, boxes, densities, transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..plans import iterate

CONTACT_SCALE = 1.02
BOX = 10
#: a cell is joined with itself and these; every pair of neighbouring cells meets once
HALF_PLANE = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy")) for a, b in pairs]))


def _cells(points: DataFrame, side: float) -> DataFrame:
    finite = points.where("not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    return finite.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))


def contact_pairs(points: DataFrame, reach: float) -> DataFrame:
    """(run_id, u, v, d2) of all pairs u < v of a run within reach; an equi-join on cells with a residual filter."""
    p = _cells(points, reach).select("run_id", "id", "x", "y", "cx", "cy")
    a = p.select("run_id", F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "cx", "cy")
    b = p.select("run_id", F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy", _offsets(HALF_PLANE).alias("o"))
    b = b.select("run_id", "b", "xb", "yb", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"))
    d2 = geometry.distance2(*(F.col(c) for c in ("xa", "ya", "xb", "yb")))
    both = a.join(b, ["run_id", "cx", "cy"]).where("a <> b and (not own or a < b)").withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    return both.select("run_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "d2")


def contact_edges(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """(run_id, u, v) of discs in touch: no further apart than 2 r CONTACT_SCALE."""
    return contact_pairs(points, 2 * radius * CONTACT_SCALE).select("run_id", "u", "v")


def first_edges(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """The first `most` edges in order of run, u and v."""
    return edges.orderBy("run_id", "u", "v").limit(most)


def pair_checks(points: DataFrame, reach: float, radius: float = 1.0) -> DataFrame:
    """(run_id, u, v, d2, collides, touches) of all pairs within reach: closer than two radii, and at contact distance."""
    low, high = geometry.contact_bounds(radius, CONTACT_SCALE)
    d2 = F.col("d2")
    near = contact_pairs(points, reach).where(geometry.is_neighbour(d2, reach))
    return near.select("run_id", "u", "v", "d2", geometry.is_collision(d2, radius).alias("collides"), d2.between(low, high).alias("touches"))


def far_from(points: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """The points with none of the others within `least`: an anti-join on neighbouring cells."""
    b = _cells(others, least).select("run_id", F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy", _offsets([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]).alias("o"))
    b = b.select("run_id", "xb", "yb", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
    a = _cells(points, least)
    near = (a["run_id"] == b["run_id"]) & (a["cx"] == b["cx"]) & (a["cy"] == b["cy"]) & ((a["x"] - b["xb"]) ** 2 + (a["y"] - b["yb"]) ** 2 < least * least)
    return a.join(b, near, "left_anti").drop("cx", "cy")


#: points that the densest cell holds where the search for neighbours begins
DENSE = 64


def nearest_other(points: DataFrame, side: float | None = None) -> DataFrame:
    """(run_id, id, distance) to the nearest other point of the run; null where it has none.

    The first cells are so small that the densest holds few points; points that find one within a cell's side are done,
    the others go on with cells of twice the side. Dense parts are so settled while cells are small, and only what is
    left is joined with larger cells. Points at one place are 0 apart and count as one in the search.
    """
    p = points.select("run_id", "id", "x", "y").where("not isnan(x) and not isnan(y)")
    places = iterate.cut(p.groupBy("run_id", "x", "y").agg(F.count("*").alias("n"), F.min("id").alias("id")), "nearest")
    b = places.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not b[0]:
        return p.select("run_id", "id", F.lit(None).cast("double").alias("distance"))
    span = max(b[2] - b[1], b[4] - b[3], 1e-9)
    if side is None:
        side = span / max(1.0, b[0] ** 0.5)
        while side > 1e-12 * span and _cells(places, side).groupBy("run_id", "cx", "cy").count().agg(F.max("count")).first()[0] > DENSE:
            side /= 4
    left, done = places.where("n = 1").select("run_id", "id", "x", "y"), None
    others = places.select("run_id", "id", "x", "y")
    while True:
        a = _cells(left, side).select("run_id", F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "cx", "cy", _offsets([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]).alias("o"))
        a = a.select("run_id", "a", "xa", "ya", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
        o = _cells(others, side).withColumnsRenamed({"id": "b", "x": "xb", "y": "yb"})
        near = a.join(o, ["run_id", "cx", "cy"]).where("a <> b").groupBy("run_id", F.col("a").alias("id")).agg(F.min(F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))).alias("distance"))
        last = side > 2 * span
        if not last:
            near = near.where(F.col("distance") <= side)
        near = iterate.cut(near, "nearest")
        done = near if done is None else done.unionByName(near)
        left = iterate.cut(left.join(near, ["run_id", "id"], "left_anti"), "nearest")
        if last or not left.limit(1).count():
            break
        side *= 2
    same = p.join(places.where("n > 1").select("run_id", "x", "y"), ["run_id", "x", "y"]).select("run_id", "id", F.lit(0.0).alias("distance"))
    return done.unionByName(same).unionByName(left.select("run_id", "id", F.lit(None).cast("double").alias("distance")))


def box_counts(points: DataFrame, side: int = BOX) -> DataFrame:
    """(run_id, bx, by, n) of the boxes, from 1; negative coordinates are cut towards zero."""
    box = [geometry.box_coordinate(F.col(c), side).alias(f"b{c}") for c in "xy"]
    return points.groupBy("run_id", *box).agg(F.count("*").alias("n"))


def box_members(points: DataFrame, side: int = BOX) -> DataFrame:
    """(run_id, bx, by, n, ids): the boxes' members in order of id. Discs that do not overlap leave room for few in a box."""
    box = [geometry.box_coordinate(F.col(c), side).alias(f"b{c}") for c in "xy"]
    return points.groupBy("run_id", *box).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def without_small_boxes(points: DataFrame, edges: DataFrame, least: int, side: int = BOX) -> tuple[DataFrame, DataFrame]:
    """Points of boxes with at least `least` members, with new ids from 1 in order, and the edges among them."""
    box = [(F.floor(F.col(c) / side)).alias(f"b{c}") for c in "xy"]
    p = points.select("*", *box)
    kept = p.join(p.groupBy("run_id", "bx", "by").count().where(F.col("count") >= least), ["run_id", "bx", "by"], "left_semi").drop("bx", "by")
    # new ids: rank within a bucket of ids plus what the buckets before hold, so no run is sorted in one task
    bucket = kept.withColumn("bucket", F.floor(F.col("id") / 4096))
    before = bucket.groupBy("run_id", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("run_id").orderBy("bucket")) - F.col("count")).drop("count")
    new = bucket.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "bucket").orderBy("id"))).join(before, ["run_id", "bucket"])
    new = new.withColumn("new_id", F.col("before") + F.col("rank")).drop("bucket", "before", "rank")
    ids = new.select("run_id", "id", "new_id")
    e = edges.join(ids.withColumnsRenamed({"id": "u", "new_id": "new_u"}), ["run_id", "u"]).join(ids.withColumnsRenamed({"id": "v", "new_id": "new_v"}), ["run_id", "v"])
    return new, e.select("run_id", F.col("new_u").alias("u"), F.col("new_v").alias("v"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.groupBy("run_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def grid_density(points: DataFrame, side: float) -> DataFrame:
    """(run_id, ix, iy, n) of the whole bins from the lower corner; the last partial bin of each axis is dropped."""
    p = points.join(bounding_box(points), "run_id")
    bin_ = lambda c: F.floor((F.col(c) - F.col(f"min_{c}")) / side).cast("long")
    full = lambda c: F.floor((F.col(f"max_{c}") - F.col(f"min_{c}")) / side)
    inside = p.withColumn("ix", bin_("x")).withColumn("iy", bin_("y")).where((F.col("ix") < full("x")) & (F.col("iy") < full("y")))
    return inside.groupBy("run_id", "ix", "iy").agg(F.count("*").alias("n"))


def density_stats(points: DataFrame, side: float) -> DataFrame:
    """Bins, filled bins, sparsity, and mean, sample deviation, maximum and minimum of counts with and without zeros."""
    g = grid_density(points, side).groupBy("run_id").agg(F.count("*").alias("filled"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.avg("n").alias("mean_filled"), F.stddev_samp("n").alias("std_filled"))
    bins = bounding_box(points).select("run_id", (F.floor((F.col("max_x") - F.col("min_x")) / side) * F.floor((F.col("max_y") - F.col("min_y")) / side)).cast("long").alias("bins"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("bins")) / (F.col("bins") - 1)
    return bins.join(g, "run_id").select("run_id", "bins", "filled", F.round(100 * (1 - F.col("filled") / F.col("bins")), 6).alias("sparsity_pct"), F.round(F.col("s") / F.col("bins"), 6).alias("mean_all"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 6).alias("std_all"), F.round("mean_filled", 6).alias("mean_filled"), F.round("std_filled", 6).alias("std_filled"), "max_n", "min_n")


def histogram_2d(points: DataFrame, bins: int = 400) -> DataFrame:
    """(run_id, ix, iy, n) on a grid of bins x bins over the bounding box; the upper edge belongs to the last bin."""
    p = points.join(bounding_box(points), "run_id")
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"min_{c}")) / ((F.col(f"max_{c}") - F.col(f"min_{c}")) / bins)), F.lit(bins - 1)).cast("long")
    return p.groupBy("run_id", at("x").alias("ix"), at("y").alias("iy")).agg(F.count("*").alias("n"))


def transform(points: DataFrame, shift: str = "min", pad: float = 5.0, scale: str | float = "identity") -> DataFrame:
    """Finite points shifted to their minimum or centre, padded, then scaled (`fit`: the longer side becomes 1)."""
    if shift not in ("min", "center"):
        raise ValueError(f"shift: {shift}")
    p = points.where("not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    p = p.join(bounding_box(p), "run_id")
    base = (lambda c: F.col(f"min_{c}")) if shift == "min" else (lambda c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2)
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) + 2 * pad
    by = F.lit(1.0) if scale == "identity" else 1 / size if scale == "fit" else F.lit(float(scale))
    return p.select("run_id", "id", *[((F.col(c) - base(c) + pad) * by).alias(c) for c in "xy"])


def corner_occupancy(points: DataFrame, size: float = 0.12, margin: float = 0.05) -> DataFrame:
    """Counts in four squares set in from the corners and the emptiest; in a tie the top right, then top left, bottom right.

    Squares are 2 `size` wide and `margin` away from the edges, both as parts of the shorter side.
    """
    b = bounding_box(points)
    p = points.join(b, "run_id")
    short = F.least(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    gap, side = F.lit(margin) * short, F.lit(2 * size) * short
    low = lambda c: F.col(c).between(F.col(f"min_{c}") + gap, F.col(f"min_{c}") + gap + side)
    high = lambda c: F.col(c).between(F.col(f"max_{c}") - gap - side, F.col(f"max_{c}") - gap)
    right, top, left, bottom = high("x"), high("y"), low("x"), low("y")
    n = p.groupBy("run_id").agg(*[F.count_if(a & c).alias(k) for k, a, c in (("tr", right, top), ("tl", left, top), ("br", right, bottom), ("bl", left, bottom))])
    least = F.least("tr", "tl", "br", "bl")
    return n.withColumn("corner", F.when(F.col("tr") == least, "tr").when(F.col("tl") == least, "tl").when(F.col("br") == least, "br").otherwise("bl"))


def principal_axis(points: DataFrame) -> DataFrame:
    """Angle of the first principal axis and the ids at the ends of the projection (smaller id in a tie)."""
    axis = points.groupBy("run_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"))
    axis = axis.withColumn("angle", 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")))
    p = points.join(axis, "run_id").withColumn("t", F.round((F.col("x") - F.col("mx")) * F.cos("angle") + (F.col("y") - F.col("my")) * F.sin("angle"), 9))
    ends = p.groupBy("run_id").agg(F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", -F.col("id"))).alias("hi"), F.first("angle").alias("angle"))
    return ends.select("run_id", F.round("angle", 6).alias("angle"), F.col("lo.id").alias("low_id"), (-F.col("hi.col2")).alias("high_id"), F.round(F.col("hi.t") - F.col("lo.t"), 6).alias("extent"))


def scale_ticks(points: DataFrame, nm_per_unit: float = 1.55, ticks: int = 8) -> DataFrame:
    """Unit, divisor and tick step (1-2-5; 1 for no span) for the longer side in nanometres, and the last tick."""
    span = bounding_box(points).select("run_id", (F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) * nm_per_unit).alias("nm"))
    unit = F.when(F.col("nm") >= 1e6, "mm").when(F.col("nm") >= 1e3, "µm").otherwise("nm")
    by = F.when(F.col("nm") >= 1e6, 1e6).when(F.col("nm") >= 1e3, 1e3).otherwise(1.0)
    s = span.withColumn("unit", unit).withColumn("divisor", by).withColumn("raw", F.col("nm") / F.col("divisor") / ticks)
    s = s.withColumn("base", F.pow(F.lit(10.0), F.floor(F.log10("raw")))).withColumn("m", F.col("raw") / F.col("base"))
    step = F.col("base") * F.when(F.col("m") <= 1, 1.0).when(F.col("m") <= 2, 2.0).when(F.col("m") <= 5, 5.0).otherwise(10.0)
    s = s.withColumn("step", F.when(F.col("raw") > 0, step).otherwise(1.0))
    return s.select("run_id", "unit", "divisor", F.round("step", 6).alias("step"), F.round(geometry.ceil_to(F.col("nm") / F.col("divisor"), F.col("step")), 6).alias("last_tick"))


def tick_places(points: DataFrame, nm_per_unit: float = 1.55, ticks: int = 8) -> DataFrame:
    """(run_id, i, tick): all ticks from 0 to the last."""
    s = scale_ticks(points, nm_per_unit, ticks)
    return s.select("run_id", F.posexplode(geometry.ticks(F.col("last_tick"), F.col("step"))).alias("i", "tick"))


def stride_sample(points: DataFrame, k: int) -> DataFrame:
    """Every k-th point of a run in order of id, beginning with the first."""
    p = points.withColumn("bucket", F.floor(F.col("id") / 4096))
    before = p.groupBy("run_id", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("run_id").orderBy("bucket")) - F.col("count")).drop("count")
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "bucket").orderBy("id"))).join(before, ["run_id", "bucket"])
    return ranked.where((F.col("before") + F.col("rank") - 1) % k == 0).select(*points.columns)


def frontier(points: DataFrame, newest: int = 40) -> DataFrame:
    """The `newest` last ids of every run."""
    return points.join(points.groupBy("run_id").agg(F.max("id").alias("last")), "run_id").where(F.col("id") > F.col("last") - newest).select(*points.columns)
