"""Planar faces of a straight-line graph: next pointers by window, orbits by pointer doubling."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans import iterate
from .graph import both_ways, dedup_edges


def half_edges(points: DataFrame, edges: DataFrame, unknown: Observation | None = None) -> DataFrame:
    """(run_id, src, dst, h, nxt, xsrc, ysrc, xdst, ydst) with the next half-edge of the face to the left.

    Edges to nodes that are not among the points are dropped; `unknown` counts them (n) while the result is made. The next of (u, v) is the half-edge out of v that comes before (v, u)
    counterclockwise, so inner faces are run through counterclockwise.
    """
    p = lambda s: points.select("run_id", F.col("id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    h = both_ways(dedup_edges(edges))
    if unknown is None:
        h = h.join(p("src"), ["run_id", "src"]).join(p("dst"), ["run_id", "dst"])
    else:
        has = lambda s: p(s).withColumn(f"has{s}", F.lit(True))
        h = h.join(has("src"), ["run_id", "src"], "left").join(has("dst"), ["run_id", "dst"], "left")
        known = F.col("hassrc").isNotNull() & F.col("hasdst").isNotNull()
        h = h.observe(unknown, F.count_if(~known & (F.col("src") < F.col("dst"))).alias("n")).where(known).drop("hassrc", "hasdst")
    w = Window.partitionBy("run_id", "src").orderBy(F.atan2(F.col("ydst") - F.col("ysrc"), F.col("xdst") - F.col("xsrc")), "dst")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = h.withColumn("before", F.coalesce(F.lag("dst").over(w), F.last("dst").over(whole)))
    # here (src, dst) is the reverse of the half-edge whose successor is (src, before)
    key = lambda a, b: F.struct("run_id", F.col(a).alias("src"), F.col(b).alias("dst"))
    return h.select("run_id", F.col("dst").alias("src"), F.col("src").alias("dst"), key("dst", "src").alias("h"), key("src", "before").alias("nxt"), *[F.col(f"{c}{a}").alias(f"{c}{b}") for a, b in (("dst", "src"), ("src", "dst")) for c in "xy"])


def loops(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Half-edges with their orbit, and (run_id, orbit, area, size, u, v) of every boundary loop; (u, v) is its smallest step.

    Places count from the loop's node u (x0, y0): far from the origin, products of whole coordinates would leave few digits of an area.
    Edges to unknown nodes are dropped, with a warning that tells their number.
    """
    unknown = Observation()
    h = iterate.cut(half_edges(points, edges, unknown), "faces")
    if unknown.get["n"]:
        warnings.warn(f"{unknown.get['n']} edges to unknown nodes dropped", stacklevel=2)
    at = lambda step, end: F.struct(f"{step}.*", F.col(f"x{end}").alias("x"), F.col(f"y{end}").alias("y"))
    o = iterate.orbits(h.select("h", "nxt", at("h", "src").alias("first"), at("nxt", "dst").alias("second")), "faces", ("first", "second"))
    o = o.select("h", F.struct("orbit.run_id", "orbit.src", "orbit.dst").alias("orbit"), F.col("orbit.x").alias("x0"), F.col("orbit.y").alias("y0"))
    cross = (F.col("xsrc") - F.col("x0")) * (F.col("ydst") - F.col("y0")) - (F.col("xdst") - F.col("x0")) * (F.col("ysrc") - F.col("y0"))
    named = h.join(o, "h").withColumn("cross", cross)
    return named, named.groupBy("run_id", "orbit").agg((0.5 * F.sum("cross")).alias("area"), F.count("*").alias("size"), F.min(F.struct("src", "dst")).alias("s")).select("run_id", "orbit", "area", "size", F.col("s.src").alias("u"), F.col("s.dst").alias("v"))


def enclosed(found: DataFrame, floor: float = 0.0, drop_outer: str = "global", points_comp: DataFrame | None = None) -> DataFrame:
    """Loops as faces: the loop of the largest |area| of every run (or component) goes, negative ones are turned, and
    those under the floor go. Ties of |area| (6 digits) go to the smaller (u, v)."""
    key = ["run_id"]
    if drop_outer == "per_component":
        found, key = found.join(points_comp.select("run_id", F.col("id").alias("u"), "comp"), ["run_id", "u"]), ["run_id", "comp"]
    elif drop_outer != "global":
        raise ValueError(f"drop_outer: {drop_outer}")
    outer = found.groupBy(*key).agg(F.min(F.struct(-F.round(F.abs("area"), 6), "u", "v")).alias("o")).select(*key, F.col("o.u").alias("ou"), F.col("o.v").alias("ov"))
    kept = found.join(outer, key).where("not (u = ou and v = ov)").drop("ou", "ov")
    return kept.withColumn("area", F.abs("area")).where(F.col("area") >= floor)


def face_areas(points: DataFrame, edges: DataFrame, floor: float = 5.0) -> DataFrame:
    """(run_id, u, v, area) of the enclosed faces of at least the floor."""
    return enclosed(loops(points, edges)[1], floor).select("run_id", "u", "v", "area")


def top_faces(found: DataFrame, most: int = 50) -> DataFrame:
    """(run_id, u, v, area, shade): the largest faces, and where their areas lie between the smallest and the largest shown."""
    top = found.withColumn("key", F.round("area", 6)).orderBy(F.desc("key"), "run_id", "u", "v").limit(most)
    ends = top.agg(F.min("area").alias("lo"), F.max("area").alias("hi"))
    shade = (F.col("area") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(2.220446049250313e-16))
    return top.crossJoin(F.broadcast(ends)).select("run_id", "u", "v", "area", shade.alias("shade"))


def centroids(points: DataFrame, named: DataFrame, found: DataFrame) -> DataFrame:
    """(run_id, u, v, cx, cy) of every loop; loops without area have the mean of their vertices."""
    side = lambda c: (F.col(f"{c}src") - F.col(f"{c}0") + F.col(f"{c}dst") - F.col(f"{c}0")) * F.col("cross")
    s = named.groupBy("run_id", "orbit").agg(F.sum("cross").alias("a2"), F.sum(side("x")).alias("sx"), F.sum(side("y")).alias("sy"), F.avg("xsrc").alias("mx"), F.avg("ysrc").alias("my"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    flat = F.abs("a2") < 1e-9
    at = lambda c: F.when(flat, F.col(f"m{c}")).otherwise(F.col(f"{c}0") + F.col(f"s{c}") / (3 * F.col("a2"))).alias(f"c{c}")
    return found.join(s.select("run_id", "orbit", at("x"), at("y")), ["run_id", "orbit"])


def inside(points: DataFrame, named: DataFrame, nodes: DataFrame, cell: float = 8.0) -> DataFrame:
    """(run_id, id, orbit): points strictly inside a loop by even-odd ray casting to the right.

    Edges are dealt to the horizontal bands they cross and, from their loop's left end to their own right end, to columns
    of a width that goes with the loop's (a power of two of at least a quarter), so an edge has a few copies and a point
    meets only edges of loops that reach around it, in its band.
    """
    p = lambda s: nodes.select("run_id", F.col("id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    e = iterate.cut(named.select("run_id", "orbit", "src", "dst").join(p("src"), ["run_id", "src"]).join(p("dst"), ["run_id", "dst"]).select("run_id", "orbit", "xsrc", "ysrc", "xdst", "ydst"), "sides")
    wide = e.groupBy("run_id", "orbit").agg(F.min("xsrc").alias("left"), F.max("xsrc").alias("right"))
    wide = wide.select("run_id", "orbit", "left", F.ceil(F.log2(F.greatest((F.col("right") - F.col("left")) / 4, F.lit(cell)))).cast("int").alias("level"))
    e = e.where("ysrc <> ydst").join(iterate.cut(wide, "loops"), ["run_id", "orbit"])
    levels = sorted(r[0] for r in wide.select("level").distinct().collect())  # a few dozen at most
    column = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("level")))
    e = e.withColumn("band", F.explode(F.sequence(F.floor(F.least("ysrc", "ydst") / cell), F.floor(F.greatest("ysrc", "ydst") / cell))))
    e = e.withColumn("column", F.explode(F.sequence(column(F.col("left")), column(F.greatest("xsrc", "xdst")))))
    q = points.select("run_id", "id", "x", "y", F.floor(F.col("y") / cell).alias("band"), F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)")).alias("level")).withColumn("column", column(F.col("x")))
    hit = (F.col("ysrc") > F.col("y")) != (F.col("ydst") > F.col("y"))
    right = F.col("x") < (F.col("xdst") - F.col("xsrc")) * (F.col("y") - F.col("ysrc")) / (F.col("ydst") - F.col("ysrc")) + F.col("xsrc")
    crossed = q.join(e.select("run_id", "band", "level", "column", "orbit", "xsrc", "ysrc", "xdst", "ydst"), ["run_id", "band", "level", "column"]).where(hit & right)
    return crossed.groupBy("run_id", "id", "orbit").agg(F.count("*").alias("n")).where("n % 2 = 1").select("run_id", "id", "orbit")


def nesting(points: DataFrame, named: DataFrame, found: DataFrame, comps: DataFrame) -> DataFrame:
    """(run_id, orbit, u, v, area, parent_u, parent_v): the smallest positive loop that holds each positive loop.

    A loop lies in another of a different component and larger area if its smallest node lies inside. (Positive loops
    of one component never hold each other.)
    """
    found = found.join(comps.select("run_id", F.col("id").alias("u"), "comp"), ["run_id", "u"])
    plus = found.where("area > 1e-9")
    held = inside(points.join(plus.select("run_id", F.col("u").alias("id")).distinct(), ["run_id", "id"], "left_semi"), named.join(plus.select("run_id", "orbit"), ["run_id", "orbit"], "left_semi"), points)
    outer = held.select("run_id", F.col("id").alias("u"), F.col("orbit").alias("outer")).join(plus.select("run_id", F.col("orbit").alias("outer"), F.col("area").alias("outer_area"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("comp").alias("outer_comp")), ["run_id", "outer"])
    best = plus.join(outer, ["run_id", "u"]).where("outer_comp <> comp and outer_area > area + 1e-9").groupBy("run_id", "orbit").agg(F.min(F.struct("outer_area", "pu", "pv")).alias("p"))
    return plus.join(best, ["run_id", "orbit"], "left").select("run_id", "orbit", "u", "v", "area", F.col("p.pu").alias("parent_u"), F.col("p.pv").alias("parent_v"))


def net_areas(nested: DataFrame) -> DataFrame:
    """(run_id, u, v, net): areas of outermost loops less holes plus islands and so on, by alternating depth.

    Every loop points to its parent, an outermost one to itself; pointers are doubled until all point to outermost loops,
    so the jobs grow with the logarithm of the depth.
    """
    top = F.col("parent_u").isNull()
    seen = {"moved": F.count_if("moved")}
    state = nested.select("run_id", "u", "v", "area", F.coalesce("parent_u", "u").alias("au"), F.coalesce("parent_v", "v").alias("av"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), (~top).alias("moved"))
    state = iterate.cut(state, "nesting", seen)
    while state.seen["moved"]:
        above = state.select("run_id", F.col("u").alias("au"), F.col("v").alias("av"), F.col("au").alias("bu"), F.col("av").alias("bv"), F.col("depth").alias("more"))
        new = state.join(above, ["run_id", "au", "av"]).select("run_id", "u", "v", "area", F.col("bu").alias("au"), F.col("bv").alias("av"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        new = iterate.cut(new, "nesting", seen)
        iterate.drop(state)
        state = new
    return state.groupBy("run_id", F.col("au").alias("u"), F.col("av").alias("v")).agg(F.sum(F.when(F.col("depth") % 2 == 0, F.col("area")).otherwise(-F.col("area"))).alias("net"))
