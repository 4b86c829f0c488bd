"""Contact-graph operators over points (run_id, id, x, y) and edges (run_id, u, v) with u < v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import iterate


def dedup_edges(edges: DataFrame, strict: bool = False) -> DataFrame:
    """Undirected edges once each, smaller id first. Self-loops are dropped; with strict they raise an error."""
    e = edges.select("run_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if strict:
        loop = F.when(F.col("u") == F.col("v"), F.raise_error(F.concat(F.lit("self-loop at "), F.col("u").cast("string"))).cast("long"))
        e = e.select("run_id", F.coalesce(loop, F.col("u")).alias("u"), "v")
    return e.where("u <> v").distinct()


def edge_difference(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, u, v, side): edges that only one list holds."""
    a, b = dedup_edges(stored), dedup_edges(expected)
    key = ["run_id", "u", "v"]
    return a.join(b, key, "left_anti").withColumn("side", F.lit("extra")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("missing")))


def edge_gaps(points: DataFrame, edges: DataFrame, radius: float = 1.0, scale: float = 1.02) -> DataFrame:
    """The edges with their ends' distance d, two radii and the contact distance."""
    end = lambda s: points.select("run_id", F.col("id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    e = edges.join(end("u"), ["run_id", "u"]).join(end("v"), ["run_id", "v"])
    return e.select(*edges.columns, F.hypot(F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv")).alias("d"), F.lit(2 * radius).alias("two_radii"), F.lit(2 * radius * scale).alias("contact"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("run_id", F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select("run_id", F.col("v").alias("src"), F.col("u").alias("dst")))


def degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, id, degree) of every point; isolated ones have 0."""
    n = edges.select("run_id", F.explode(F.array("u", "v")).alias("id")).groupBy("run_id", "id").agg(F.count("*").alias("degree"))
    return points.select("run_id", "id").join(n, ["run_id", "id"], "left").select("run_id", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_histogram(points: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(points, edges).groupBy("run_id", "degree").agg(F.count("*").alias("n"))


def over_connected(points: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    return degrees(points, edges).where(F.col("degree") > most)


def turn(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two directions in radians, 0 where one has no length."""
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size)))).otherwise(0.0)


def turn_deviations(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, id, deviation) of nodes of degree 2: how far the path through them is from straight, in degrees."""
    p = points.select("run_id", F.col("id").alias("src"), F.col("x").alias("xs"), F.col("y").alias("ys"))
    q = points.select("run_id", F.col("id").alias("dst"), F.col("x").alias("xd"), F.col("y").alias("yd"))
    h = both_ways(edges).join(p, ["run_id", "src"]).join(q, ["run_id", "dst"])
    n = h.groupBy("run_id", "src").agg(F.count("*").alias("n"), F.min(F.struct("dst", "xd", "yd")).alias("a"), F.max(F.struct("dst", "xd", "yd")).alias("b"), F.first("xs").alias("x"), F.first("ys").alias("y")).where("n = 2")
    into, out = (F.col("x") - F.col("a.xd"), F.col("y") - F.col("a.yd")), (F.col("b.xd") - F.col("x"), F.col("b.yd") - F.col("y"))
    flat = (F.hypot(*into) == 0) | (F.hypot(*out) == 0)
    return n.select("run_id", F.col("src").alias("id"), F.when(flat, 180.0).otherwise(F.degrees(turn(*into, *out))).alias("deviation"))


def turning_nodes(points: DataFrame, edges: DataFrame, least: float = 20.0) -> DataFrame:
    return turn_deviations(points, edges).where(F.round("deviation", 6) >= least)


def node_roles(points: DataFrame, edges: DataFrame, least: float = 15.0) -> DataFrame:
    """(run_id, id, role): isolated, leaf, junction, turning or interim_straight."""
    d = degrees(points, edges).join(turn_deviations(points, edges), ["run_id", "id"], "left")
    role = F.when(F.col("degree") == 0, "isolated").when(F.col("degree") == 1, "leaf").when(F.col("degree") >= 3, "junction").when(F.round("deviation", 6) >= least, "turning").otherwise("interim_straight")
    return d.select("run_id", "id", role.alias("role"))


def role_counts(points: DataFrame, edges: DataFrame, least: float = 15.0) -> DataFrame:
    """(run_id, role, n)."""
    return node_roles(points, edges, least).groupBy("run_id", "role").agg(F.count("*").alias("n"))


def end_nodes(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, id, kind): endpoints with one edge, and junctions with three or more."""
    d = degrees(points, edges).where("degree = 1 or degree >= 3")
    return d.select("run_id", "id", F.when(F.col("degree") == 1, "endpoint").otherwise("junction").alias("kind"))


def _node(c: str) -> Column:
    """A node of all runs: no hash, so no two are ever taken for one."""
    return F.struct("run_id", F.col(c).alias("id"))


def components(points: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(run_id, id, comp): the smallest id that a node reaches; isolated nodes are their own.

    With targets (run_id, n_target), ids from 1 to a run's target that were not placed are nodes, too, each on its own.
    """
    found = iterate.cut(iterate.components(edges.select(_node("u").alias("a"), _node("v").alias("b"))), "components")
    found = found.select("id.run_id", "id.id", F.col("component.id").alias("comp"))
    nodes = points.select("run_id", "id")
    if targets is not None:
        step = 1 << 16  # ids of a target in pieces
        t = targets.select("run_id", F.col("n_target").cast("long").alias("n")).where("n > 0").withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {step})")))
        nodes = nodes.union(t.select("run_id", F.explode(F.expr(f"sequence(k * {step} + 1, least(n, (k + 1) * {step}))")))).distinct()
    return nodes.join(found, ["run_id", "id"], "left").select("run_id", "id", F.coalesce("comp", "id").alias("comp"))


def two_core(edges: DataFrame) -> DataFrame:
    """Edges of the 2-core: nodes with at most one edge are dropped until none is left.

    A round drops whole chains that end in a leaf: nodes with at most two edges are grouped by components, and those with
    a node of one edge go. So the rounds follow the branching of trees, not the length of their branches.
    """
    e = iterate.cut(edges.select("run_id", "u", "v"), "core")
    while True:
        deg = iterate.cut(e.select("run_id", F.explode(F.array("u", "v")).alias("id")).groupBy("run_id", "id").agg(F.count("*").alias("n")), "degrees")
        if not deg.where("n = 1").limit(1).count():
            return e
        thin = deg.where("n <= 2").select("run_id", "id")
        inner = e.join(thin.withColumnRenamed("id", "u"), ["run_id", "u"], "left_semi").join(thin.withColumnRenamed("id", "v"), ["run_id", "v"], "left_semi")
        chain = components(thin, inner).join(deg, ["run_id", "id"])
        gone = iterate.cut(chain.join(chain.where("n = 1").select("run_id", "comp").distinct(), ["run_id", "comp"], "left_semi").select("run_id", "id"), "gone")
        new = e.join(gone.withColumnRenamed("id", "u"), ["run_id", "u"], "left_anti").join(gone.withColumnRenamed("id", "v"), ["run_id", "v"], "left_anti")
        new = iterate.cut(new.select("run_id", "u", "v"), "core")
        iterate.drop(e)
        e = new


def segments(edges: DataFrame) -> DataFrame:
    """(run_id, seg, pos, id): maximal chains through nodes of degree 2, each in one direction.

    seg names a chain by its first node and step. A half-edge's successor goes on through a node of degree 2; pointer
    doubling finds every half-edge's place. Chains keep the direction with the smaller (first, second) node; pure cycles start at
    their smallest node towards its smaller neighbour and are closed (first = last).
    """
    h = both_ways(edges)
    deg = h.groupBy("run_id", "src").agg(F.count("*").alias("deg"), F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    back = deg.where("deg = 2").select("run_id", F.col("src"), "lo", "hi")
    # predecessor of (src, dst): the other half-edge into src, where src has degree 2
    k = iterate.cut(h.join(back, ["run_id", "src"], "left").select("run_id", "src", "dst", F.when(F.col("lo").isNotNull(), F.when(F.col("lo") == F.col("dst"), F.col("hi")).otherwise(F.col("lo"))).alias("before")), "halfedges")
    # pointer: the half-edge 2^i steps back; rank: steps to the chain's first; low: the smallest step of a cycle so far
    s = k.select("run_id", "src", "dst", F.when(F.col("before").isNull(), F.col("src")).otherwise(F.col("before")).alias("ps"), F.when(F.col("before").isNull(), F.col("dst")).otherwise(F.col("src")).alias("pd"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.col("before").isNull().alias("done"))
    s = s.withColumn("low", F.least(F.struct("src", "dst"), F.struct(F.col("ps").alias("src"), F.col("pd").alias("dst"))))
    s = iterate.cut(s, "chains")
    span = 1
    left = None
    while True:
        o = s.select("run_id", F.col("src").alias("ps"), F.col("dst").alias("pd"), F.col("ps").alias("ps2"), F.col("pd").alias("pd2"), F.col("rank").alias("rank2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        new = s.join(o, ["run_id", "ps", "pd"]).select(
            "run_id", "src", "dst", F.when(F.col("done"), F.col("ps")).otherwise(F.col("ps2")).alias("ps"), F.when(F.col("done"), F.col("pd")).otherwise(F.col("pd2")).alias("pd"),
            F.when(F.col("done"), F.col("rank")).otherwise(F.col("rank") + F.col("rank2")).alias("rank"), (F.col("done") | F.col("done2")).alias("done"), F.least("low", "low2").alias("low"),
        )
        new = iterate.cut(new, "chains")
        now = new.agg(F.count_if(~F.col("done")), F.sum(F.when(~F.col("done"), F.xxhash64("low.src", "low.dst").cast("decimal(38,0)")))).first()
        iterate.drop(s)
        s, span = new, span * 2
        if not now[0] or tuple(now) == left:
            break
        left = tuple(now)
    open_ = s.where("done").select("run_id", F.col("ps").alias("a"), F.col("pd").alias("b"), "rank", "src", "dst")
    ends = open_.groupBy("run_id", "a", "b").agg(F.max(F.struct("rank", "dst", "src")).alias("end"))
    kept = ends.where("a < end.dst or (a = end.dst and b <= end.src)").select("run_id", "a", "b")
    chain = open_.join(kept, ["run_id", "a", "b"])
    nodes = chain.select("run_id", "a", "b", (F.col("rank") + 1).alias("pos"), F.col("dst").alias("id")).unionByName(kept.select("run_id", "a", "b", F.lit(0).cast("long").alias("pos"), F.col("a").alias("id")))
    # cycles: both directions have smallest steps from the same node; the smaller is kept, and ranks count from it
    loop = s.where("not done").select("run_id", "src", "dst", "low")
    start = loop.groupBy("run_id", F.col("low.src").alias("n")).agg(F.min("low").alias("low"))
    loop = loop.join(start.select("run_id", "low"), ["run_id", "low"], "left_semi")
    ring = _cycle_ranks(loop, k)
    nodes = nodes.unionByName(ring)
    return nodes.select("run_id", F.concat_ws("-", "a", "b").alias("seg"), "pos", "id")


def segments_by_component(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(run_id, comp, seg, pos, id): the segments of the edges, each once, with their component."""
    s = segments(dedup_edges(edges))
    return s.join(comps.select("run_id", "id", "comp"), ["run_id", "id"]).select("run_id", "comp", "seg", "pos", "id")


def _cycle_ranks(loop: DataFrame, halfedges: DataFrame) -> DataFrame:
    """(run_id, a, b, pos, id) along pure cycles: the step to the start is cut, then places double up as in chains."""
    s = loop.join(halfedges, ["run_id", "src", "dst"])
    first = (F.col("src") == F.col("low.src")) & (F.col("dst") == F.col("low.dst"))
    s = s.select("run_id", "src", "dst", "low", F.when(first, F.col("src")).otherwise(F.col("before")).alias("ps"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("pd"), F.when(first, 0).otherwise(1).cast("long").alias("rank"), first.alias("done"))
    s = iterate.cut(s, "cycles")
    while s.where("not done").limit(1).count():
        o = s.select("run_id", F.col("src").alias("ps"), F.col("dst").alias("pd"), F.col("ps").alias("ps2"), F.col("pd").alias("pd2"), F.col("rank").alias("rank2"), F.col("done").alias("done2"))
        s = iterate.cut(s.join(o, ["run_id", "ps", "pd"]).select("run_id", "src", "dst", "low", F.col("ps2").alias("ps"), F.col("pd2").alias("pd"), (F.col("rank") + F.col("rank2")).alias("rank"), (F.col("done") | F.col("done2")).alias("done")), "cycles")
    a, b = F.col("low.src").alias("a"), F.col("low.dst").alias("b")
    return s.select("run_id", a, b, (F.col("rank") + 1).alias("pos"), F.col("dst").alias("id")).unionByName(s.where("rank = 0").select("run_id", a, b, F.lit(0).cast("long").alias("pos"), F.col("src").alias("id")))


#: positions of a segment that are worked on together
BLOCK = 4096


def _blocks(seg: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Rows of seg by blocks of positions, with copies of the last rows before each block and the first ones after it (own is false). So
    neighbours are found in groups of bounded size, however long a segment is. Positions must count up by one."""
    b, at = F.floor(F.col("pos") / BLOCK), F.pmod(F.col("pos"), F.lit(BLOCK))
    copies = [b, *([F.when(at < after, b - 1)] if after else []), *([F.when(at >= BLOCK - before, b + 1)] if before else [])]
    return seg.withColumn("block", F.explode(F.array_compact(F.array(*copies)))).withColumn("own", F.col("block") == b)


_IN_BLOCK = ("run_id", "seg", "block")


def _along(points: DataFrame, seg: DataFrame) -> DataFrame:
    w = Window.partitionBy(*_IN_BLOCK).orderBy("pos")
    s = _blocks(seg.join(points.select("run_id", "id", "x", "y"), ["run_id", "id"]), after=2)
    return s.select("*", *[F.lead(c, n).over(w).alias(f"{c}{n}") for c in ("id", "x", "y") for n in (1, 2)]).where("own")


def segment_lengths(points: DataFrame, seg: DataFrame, least: float = 1e-9) -> DataFrame:
    """(run_id, seg, nodes, length) of segments with a finite length over `least`; repeated nodes in a row count once."""
    step = F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))
    new = F.col("id1").isNull() | (F.col("id1") != F.col("id"))
    s = _along(points, seg).groupBy("run_id", "seg").agg(F.count_if(new).alias("nodes"), F.sum(step).alias("length"))
    return s.where((F.col("length") > least) & (F.col("length") < float("inf")))


def segment_curvature(points: DataFrame, seg: DataFrame) -> DataFrame:
    """(run_id, seg, total, mean, density): turning in radians, over interior nodes and by length; steps without length turn 0."""
    s = _along(points, seg)
    step = (F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))
    after = (F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    t = s.withColumn("t", F.when(F.col("id2").isNotNull(), turn(*step, *after)))
    g = t.groupBy("run_id", "seg").agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("total"), F.count("id2").alias("inner"), F.sum(F.hypot(*step)).alias("length"))
    return g.select("run_id", "seg", "total", F.when(F.col("inner") > 0, F.col("total") / F.col("inner")).otherwise(0.0).alias("mean"), F.when(F.col("length") > 0, F.col("total") / F.col("length")).otherwise(0.0).alias("density"))


def segment_turnings(points: DataFrame, seg: DataFrame, least: float = 60.0, gap: int = 2) -> DataFrame:
    """(run_id, seg, pos, id) of turning nodes along segments, each at least `gap` steps after the last accepted.

    Every flagged node points to the first one at least a gap later; the accepted ones are those that pointers lead to from the first.
    """
    w = Window.partitionBy(*_IN_BLOCK).orderBy("pos")
    s = _blocks(seg.join(points.select("run_id", "id", "x", "y"), ["run_id", "id"]), before=1, after=1)
    s = s.select("*", *[f(c).over(w).alias(n) for f, p in ((F.lag, "a"), (F.lead, "b")) for c, n in (("x", f"{p}x"), ("y", f"{p}y"))])
    t = s.where("own and ax is not null and bx is not null").withColumn("dev", F.degrees(turn(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), F.col("bx") - F.col("x"), F.col("by") - F.col("y"))))
    flagged = iterate.cut(t.where(F.round("dev", 6) >= least).select("run_id", "seg", "pos", "id"), "flagged")
    first = flagged.groupBy("run_id", "seg").agg(F.min("pos").alias("pos"))
    kept = iterate.along_pointers(_next_flagged(flagged, gap), first, ["run_id", "seg"], "pos", "to", "turnings")
    return kept.join(flagged, ["run_id", "seg", "pos"]).select("run_id", "seg", "pos", "id")


def _next_flagged(flagged: DataFrame, gap: int) -> DataFrame:
    """(run_id, seg, pos, to): the first flagged position at least gap after each: in the block where that begins, or the first of a later block."""
    asks = flagged.select("run_id", "seg", (F.col("pos") + gap).alias("at"), "pos", F.lit(None).cast("long").alias("flag"))
    rows = asks.unionByName(flagged.select("run_id", "seg", F.col("pos").alias("at"), F.lit(None).cast("long").alias("pos"), F.col("pos").alias("flag")))
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    here = Window.partitionBy(*_IN_BLOCK).orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy("run_id", "seg").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy(*_IN_BLOCK).agg(F.min("flag").alias("flag")).select(*_IN_BLOCK, F.min("flag").over(later).alias("later"))
    found = rows.withColumn("to", F.min("flag").over(here)).where("pos is not null").join(firsts, list(_IN_BLOCK))
    return found.select("run_id", "seg", "pos", F.coalesce("to", "later").alias("to")).where("to is not null")


def refined_segments(seg: DataFrame, flags: DataFrame) -> DataFrame:
    """(run_id, seg, piece, pos, id): segments cut at flagged inner nodes, which belong to both pieces. Pieces are counted within blocks of
    positions, then over blocks."""
    ends = seg.groupBy("run_id", "seg").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    f = seg.join(flags.select("run_id", "seg", "pos", F.lit(1).alias("flag")).distinct(), ["run_id", "seg", "pos"], "left").join(ends, ["run_id", "seg"])
    f = _blocks(f.withColumn("flag", F.when(F.col("pos").isin(F.col("first"), F.col("last")), 0).otherwise(F.coalesce("flag", F.lit(0))))).drop("first", "last", "own")
    before = Window.partitionBy("run_id", "seg").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = f.groupBy(*_IN_BLOCK).agg(F.sum("flag").alias("n")).select(*_IN_BLOCK, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    f = f.withColumn("within", F.sum("flag").over(Window.partitionBy(*_IN_BLOCK).orderBy("pos"))).join(sums, list(_IN_BLOCK))
    f = f.withColumn("piece", F.col("before") + F.col("within"))
    return f.select("run_id", "seg", F.explode(F.when(F.col("flag") == 1, F.array(F.col("piece") - 1, F.col("piece"))).otherwise(F.array("piece"))).alias("piece"), "pos", "id")


def spanning_forest(edges: DataFrame, weight: str = "w", largest: bool = False) -> DataFrame:
    """Edges (run_id, u, v, w) of the minimum (or maximum) spanning forest by Boruvka rounds; ties by (u, v)."""
    sign = -1 if largest else 1
    e = iterate.cut(edges.select("run_id", "u", "v", (F.col(weight) * sign).alias("w"), _node("u").alias("a"), _node("v").alias("b")), "forest")
    taken = None
    while e.limit(1).count():
        ends = e.select(F.col("a").alias("c"), "w", "u", "v", "run_id", "a", "b").unionByName(e.select(F.col("b").alias("c"), "w", "u", "v", "run_id", "a", "b"))
        best = iterate.cut(ends.groupBy("c").agg(F.min(F.struct("w", "run_id", "u", "v", "a", "b")).alias("m")).select("m.*").distinct(), "forest")
        taken = best if taken is None else taken.unionByName(best)
        merged = iterate.cut(iterate.components(best.select("a", "b"), "forest"), "forest")
        side = lambda s: merged.select(F.col("id").alias(s), F.col("component").alias(f"c{s}"))
        new = e.join(side("a"), "a", "left").join(side("b"), "b", "left").select("run_id", "u", "v", "w", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        e = iterate.cut(new, "forest")
    if taken is None:
        return edges.select("run_id", "u", "v", F.col(weight).cast("double").alias("w")).limit(0)
    return taken.select("run_id", "u", "v", (F.col("w") * sign + 0.0).alias("w"))
