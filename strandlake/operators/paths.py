"""Path operators over components of any size: breadth-first sweeps, weighted and turn-aware shortest paths, far pairs, backbones.

Searches run on tiles (plans/tiled.py), so a component is spread over as many tasks as it needs; all components are searched at once.
Turn-aware paths, path rows of backbones and longest paths of components that fit into a pack (plans/packed.py) are found there, by the same rules.
The farthest node of a sweep is that of the largest cost (to nine digits), then of the smallest id. On a path a node's predecessor is the one
with the smallest id among those on shortest paths; paths are rows, found by pointer doubling. Steps without length count as 1e-9 long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import iterate, packed
from ..plans.tiled import Tiled, along_curve, numbered
from . import graph

KEY = ["run_id", "comp"]
#: pairs of far nodes that are looked for: one less than this
SEEDS = 8
SHORTEST = packed.SHORTEST
MODES = ("geodesic", "turnaware", "both")


@dataclass
class Network:
    """nodes: run_id, comp, id, x, y, sid. halves: u, v (sids), dx, dy, size of every edge in both directions."""

    nodes: DataFrame
    halves: DataFrame
    _graphs: dict = field(default_factory=dict)

    def graph(self, by_length: bool = False) -> Tiled:
        """Nodes are states; a step costs 1 or its length."""
        if by_length not in self._graphs:
            cost = F.col("size") if by_length else F.lit(1.0)
            self._graphs[by_length] = Tiled(self.halves.select(F.col("u").alias("a"), F.col("v").alias("b"), cost.alias("cost"), F.col("size").alias("length")))
        return self._graphs[by_length]

    def turns(self, lam: float, by_length: bool) -> tuple[Tiled, DataFrame]:
        """Half-edges are states (u, v, sid, step, size); the next step costs 1 or its length, and lam' (1 - cos turn), lam' = lam pi^2 / 2."""
        key = (lam, by_length)
        if key not in self._graphs:
            states = self._graphs.get("states")
            if states is None:  # numbered by the node that they lead to
                states = self._graphs["states"] = numbered(self.halves, ["v", "u"], "states")
            step = F.col("size") if by_length else F.lit(1.0)
            h = states.withColumn("step", step)
            self._graphs[key] = Tiled(_turn_arcs(h, lam), "turns"), h
        return self._graphs[key]


def _turn_arcs(h: DataFrame, lam: float) -> DataFrame:
    """Arcs (a, b, cost, length) from every half-edge to those that go on from its end."""
    before = h.select(F.col("v").alias("u"), F.col("sid").alias("a"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
    flat = F.hypot("ax", "ay") * F.hypot("dx", "dy")
    cosine = F.when(flat > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / flat))).otherwise(1.0)
    return before.join(h, "u").select("a", F.col("sid").alias("b"), (F.col("step") + F.lit(0.5 * math.pi**2 * lam) * (1 - cosine)).alias("cost"), F.col("size").alias("length"))


def network(points: DataFrame, edges: DataFrame, comps: DataFrame) -> Network:
    """The graph with its nodes numbered along a space-filling curve. Self-loops and repeated edges do not matter."""
    p = comps.select("run_id", "id", "comp").join(points.select("run_id", "id", "x", "y"), ["run_id", "id"])
    nodes = numbered(along_curve(p), ["run_id", "z", "id"], "nodes").drop("z")
    return Network(nodes, _halves(nodes, edges))


def _halves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    end = lambda s: nodes.select("run_id", F.col("id").alias(s), F.col("sid").alias(f"s{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    e = graph.dedup_edges(edges).join(end("u"), ["run_id", "u"]).join(end("v"), ["run_id", "v"])
    dx, dy = F.col("xv") - F.col("xu"), F.col("yv") - F.col("yu")
    size = F.greatest(F.hypot(dx, dy), F.lit(SHORTEST))
    one = e.select(F.col("su").alias("u"), F.col("sv").alias("v"), dx.alias("dx"), dy.alias("dy"), size.alias("size"))
    return iterate.cut(one.unionByName(e.select(F.col("sv").alias("u"), F.col("su").alias("v"), (-dx).alias("dx"), (-dy).alias("dy"), size.alias("size"))), "halves")


def _from(starts: DataFrame) -> DataFrame:
    """Starts (slot, sid) with nothing on their way yet."""
    return starts.select("slot", "sid", F.lit(0.0).alias("cost"), F.lit(0.0).alias("steps"), F.lit(0.0).alias("length"))


def _best(rows: DataFrame, cost: str = "cost") -> DataFrame:
    """(run_id, comp, slot, sid, id, cost, steps) of the farthest node."""
    top = F.min(F.struct((-F.round(cost, 9)).alias("less"), "id", "sid", F.col(cost).alias("cost"), "steps"))
    return rows.groupBy(*KEY, "slot").agg(top.alias("t")).select(*KEY, "slot", "t.sid", "t.id", "t.cost", "t.steps")


def reached(g: Tiled, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(run_id, comp, slot, sid, id, cost, steps, length) of every node that the starts (slot, sid) reach."""
    return g.search(_from(starts)).join(nodes.select(*KEY, "id", "sid"), "sid")


def farthest(g: Tiled, nodes: DataFrame, starts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The farthest node from each start, of the nodes of `among` where given."""
    return iterate.cut(_best(reached(g, nodes if among is None else among, starts)), "farthest")


def _smallest(nodes: DataFrame) -> DataFrame:
    first = nodes.groupBy(*KEY).agg(F.min(F.struct("id", "sid")).alias("m"))
    return first.select(*KEY, F.lit(0).alias("slot"), "m.sid", "m.id")


def two_sweeps(g: Tiled, nodes: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(run_id, comp, a, b, a_id, b_id, cost, steps): a is farthest from the smallest node, b from a."""
    among = nodes if among is None else among
    a = farthest(g, nodes, _smallest(among), among)
    b = farthest(g, nodes, a, among)
    return iterate.cut(a.select(*KEY, F.col("sid").alias("a"), F.col("id").alias("a_id")).join(b.select(*KEY, F.col("sid").alias("b"), F.col("id").alias("b_id"), "cost", "steps"), KEY), "sweeps")


def distances(points: DataFrame, edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(run_id, comp, id, dist): steps from the component's smallest node; isolated nodes have 0."""
    net = network(points, edges, comps)
    return reached(net.graph(), net.nodes, _smallest(net.nodes)).select(*KEY, "id", F.col("cost").cast("long").alias("dist"))


def lengths(points: DataFrame, edges: DataFrame, comps: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(run_id, comp, id, start, length): shortest lengths from the nodes (run_id, id) of starts, or the smallest of each component.
    Several starts of one component are searched in several slots."""
    net = network(points, edges, comps)
    first = _smallest(net.nodes)
    if starts is not None:
        s = starts.select("run_id", "id").distinct().join(net.nodes, ["run_id", "id"])
        slot = F.row_number().over(Window.partitionBy(*KEY).orderBy("id")) - 1
        first = iterate.cut(s.select(*KEY, slot.alias("slot"), "sid", "id"), "starts")
    found = reached(net.graph(True), net.nodes, first)
    return found.join(first.select(*KEY, "slot", F.col("id").alias("start")), [*KEY, "slot"]).select(*KEY, "id", "start", F.col("cost").alias("length"))


def turn_aware(net: Network, pairs: DataFrame, lam: float, by_length: bool = False) -> DataFrame:
    """pairs (run_id, comp, slot, a, b) with cost, steps and length of the cheapest way from a to b over directed edges. The first step has no
    turn; turning back is allowed."""
    g, h = net.turns(lam, by_length)
    p = pairs.select(*KEY, "slot", "a", "b")
    out = p.where("a <> b").join(h.withColumnRenamed("u", "a"), "a").select("slot", "sid", F.col("step").alias("cost"), F.lit(1.0).alias("steps"), F.col("size").alias("length"))
    ends = p.where("a <> b").join(h.select(F.col("v").alias("b"), "sid"), "b")
    got = g.search(out).join(ends, ["slot", "sid"]).groupBy(*KEY, "slot").agg(F.min(F.struct(F.round("cost", 9).alias("r"), "steps", "length", "cost")).alias("m"))
    same = p.where("a = b").select(*KEY, "slot", F.lit(0.0).alias("cost"), F.lit(0.0).alias("steps"), F.lit(0.0).alias("length"))
    return iterate.cut(got.select(*KEY, "slot", "m.cost", "m.steps", "m.length").unionByName(same), "turn_aware")


def turn_aware_costs(points: DataFrame, edges: DataFrame, comps: DataFrame, lam: float = 0.5, by_length: bool = False) -> DataFrame:
    """(run_id, comp, a, b, cost, hops) of the turn-aware path between the double sweep's ends, for components with edges."""
    small, large, between = packed.parted(edges, comps)

    def kernel(p: packed.Pack) -> dict:
        a, b, labels = p.sweeps()
        some = np.flatnonzero(labels[1][b] > 0)
        cost, steps, _ = packed.Turns(p, lam, by_length).ways(a[some], b[some])
        some, cost, steps = (v[np.isfinite(cost)] for v in (some, cost, steps))
        return _keys(p, some) | {"a": p.ids[a[some]], "b": p.ids[b[some]], "cost": cost, "hops": steps.astype(np.int64)}

    out = packed.solved(points, edges, small, kernel, "run_id long, comp long, a long, b long, cost double, hops long").withColumn("cost", F.round("cost", 6))
    if large is None:
        return out
    net = network(points, between, large)
    ends = two_sweeps(net.graph(), net.nodes).where("steps > 0").withColumn("slot", F.lit(0))
    t = turn_aware(net, ends, lam, by_length)
    return out.unionByName(ends.select(*KEY, "a_id", "b_id").join(t, KEY).select(*KEY, F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("cost", 6).alias("cost"), F.col("steps").cast("long").alias("hops")))


def _keys(p: packed.Pack, of: np.ndarray) -> dict:
    return {"run_id": p.run[of], "comp": p.comp[of]}


def core_nodes(net: Network, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and half-edges of the 2-core."""
    core = graph.two_core(graph.dedup_edges(edges))
    inside = core.select("run_id", F.explode(F.array("u", "v")).alias("id")).distinct()
    nodes = iterate.cut(net.nodes.join(inside, ["run_id", "id"], "left_semi").select(net.nodes.columns), "core_nodes")
    return nodes, _halves(nodes, core)


def _ends(net: Network, edges: DataFrame, mode: str, lam: float, peel: bool) -> DataFrame:
    """(run_id, comp, a, b, steps, turned): ends and steps of each component's backbone, and whether it is a turn-aware path."""
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")
    plain = two_sweeps(net.graph(), net.nodes).select(*KEY, "a", "b", "steps")
    if mode == "geodesic":
        return plain.withColumn("turned", F.lit(False))
    ends = plain.where("steps > 0").select(*KEY, "a", "b")
    if peel:
        nodes, halves = core_nodes(net, edges)
        c = two_sweeps(Network(nodes, halves).graph(), nodes).select(*KEY, F.col("a").alias("ca"), F.col("b").alias("cb"))
        inside = lambda e: nodes.select(F.col("sid").alias(e), F.lit(True).alias(f"{e}_in"))
        e = ends.join(inside("a"), "a", "left").join(inside("b"), "b", "left").join(c, KEY, "left")
        both = F.col("a_in") & F.col("b_in")  # the core has both, so it has several nodes
        ends = e.select(*KEY, F.when(both, F.col("ca")).otherwise(F.col("a")).alias("a"), F.when(both, F.col("cb")).otherwise(F.col("b")).alias("b"))
    ends = iterate.cut(ends.withColumn("slot", F.lit(0)), "ends")
    t = turn_aware(net, ends, lam).join(ends.select(*KEY, F.col("a").alias("ta"), F.col("b").alias("tb")), KEY)
    j = plain.join(t.select(*KEY, F.col("steps").alias("tsteps"), "ta", "tb"), KEY, "left")
    turned = F.col("tsteps").isNotNull() if mode == "turnaware" else F.coalesce(F.col("tsteps") > F.col("steps"), F.lit(False))
    j = j.withColumn("turned", turned)
    pick = lambda n, t, p: F.when(F.col("turned"), F.col(t)).otherwise(F.col(p)).alias(n)
    return j.select(*KEY, pick("a", "ta", "a"), pick("b", "tb", "b"), pick("steps", "tsteps", "steps"), "turned")


def backbones(points: DataFrame, edges: DataFrame, comps: DataFrame, mode: str = "both", lam: float = 0.5, peel: bool = True) -> DataFrame:
    """(run_id, comp, a, b, hops, turned) of every component's backbone: a double-sweep path, or a turn-aware one between its ends (re-picked in
    the 2-core where both lie in it); `both` takes the turn-aware one only if it has more steps. Isolated nodes have 0."""
    net = network(points, edges, comps)
    e = _ends(net, edges, mode, lam, peel)
    name = lambda s: net.nodes.select(F.col("sid").alias(s), F.col("id").alias(f"{s}_id"))
    return e.join(name("a"), "a").join(name("b"), "b").select(*KEY, F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("steps").cast("long").alias("hops"), "turned")


def backbone_nodes(points: DataFrame, edges: DataFrame, comps: DataFrame, mode: str = "both", lam: float = 0.5, peel: bool = True) -> DataFrame:
    """(run_id, comp, pos, id): the nodes of every component's backbone in order."""
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")
    small, large, between = packed.parted(edges, comps)
    out = packed.solved(points, edges, small, lambda p: _packed_backbones(p, mode, lam, peel), "run_id long, comp long, pos long, id long")
    if large is None:
        return out
    net = network(points, between, large)
    e = iterate.cut(_ends(net, between, mode, lam, peel).withColumn("slot", F.lit(0)), "ends")
    out = out.unionByName(path_nodes(net, e.where("not turned")))
    if mode == "geodesic":
        return out
    return out.unionByName(turn_aware_nodes(net, e.where("turned"), lam))


def _packed_backbones(p: packed.Pack, mode: str, lam: float, peel: bool) -> dict:
    """The rows of backbone_nodes() for a pack; its ends by the rules of _ends()."""
    a, b, labels = p.sweeps()
    turned, turns, ta, tb = np.zeros(len(a), bool), None, a, b
    if mode != "geodesic":
        if peel:
            core = p.core()
            ca, cb, _ = p.only(core[p.u] & core[p.v]).sweeps(among=core)
            both = core[a] & core[b]
            ta, tb = np.where(both, ca, a), np.where(both, cb, b)
        some, turns = np.flatnonzero(labels[1][b] > 0), packed.Turns(p, lam, False)
        steps = turns.ways(ta[some], tb[some])[1]
        turned[some] = np.isfinite(steps) if mode == "turnaware" else steps > labels[1][b[some]]
    plain = np.flatnonzero(~turned)
    up = packed.before(p.src, p.dst, np.ones(len(p.src)), labels[0], np.arange(p.n))
    which, nodes, pos = packed.traced(up, b[plain])
    rows = [(plain[which], pos, nodes)]
    bent = np.flatnonzero(turned)
    if len(bent):
        cost = turns.from_nodes(ta[bent])[0]
        at, of = turns.into(tb[bent])
        order = np.lexsort((p.src[at], np.round(cost[at], 9), of))
        _, firsts = np.unique(of[order], return_index=True)
        which, states, pos = packed.traced(packed.before(turns.tail, turns.to, turns.cost, cost, p.src), at[order[firsts]])
        rows += [(bent, np.zeros(len(bent), np.int64), ta[bent]), (bent[which], pos + 1, p.dst[states])]
    of, pos, nodes = (np.concatenate(v) for v in zip(*rows))
    return _keys(p, of) | {"pos": pos, "id": p.ids[nodes]}


def path_nodes(net: Network, pairs: DataFrame, by_length: bool = False) -> DataFrame:
    """(run_id, comp, pos, id): a shortest path for each of the pairs (run_id, comp, slot, a, b)."""
    found = net.graph(by_length).search(_from(pairs.select("slot", F.col("a").alias("sid"))))
    arcs = net.halves.select(F.col("u").alias("a"), F.col("v").alias("b"), (F.col("size") if by_length else F.lit(1.0)).alias("cost"))
    ids = net.nodes.select("sid", "id")
    walked = _traced(arcs, found, ids.select("sid", F.col("id").alias("tie")), pairs.select(*KEY, "slot", F.col("b").alias("sid")))
    return walked.join(ids, "sid").select(*KEY, "pos", "id")


def turn_aware_nodes(net: Network, pairs: DataFrame, lam: float, by_length: bool = False) -> DataFrame:
    """(run_id, comp, pos, id): the cheapest turn-aware path for each of the pairs (run_id, comp, slot, a, b)."""
    g, h = net.turns(lam, by_length)
    ids = net.nodes.select("sid", "id")
    p = pairs.select(*KEY, "slot", "a", "b")
    started = p.where("a <> b").join(h.withColumnRenamed("u", "a"), "a").select("slot", "sid", F.col("step").alias("cost"), F.lit(1.0).alias("steps"), F.col("size").alias("length"))
    found = g.search(started)
    last = p.where("a <> b").join(h.select(F.col("v").alias("b"), F.col("u").alias("tail"), "sid"), "b").join(found, ["slot", "sid"]).join(ids.select(F.col("sid").alias("tail"), F.col("id").alias("tail_id")), "tail")
    last = last.groupBy(*KEY, "slot").agg(F.min(F.struct(F.round("cost", 9).alias("r"), "tail_id", "sid")).alias("m")).select(*KEY, "slot", "m.sid")
    ties = h.join(ids.withColumnRenamed("sid", "u"), "u").select("sid", F.col("id").alias("tie"))
    walked = _traced(_turn_arcs(h, lam).drop("length"), found, ties, iterate.cut(last, "last"))
    heads = walked.join(h.select("sid", "v"), "sid").join(ids.withColumnRenamed("sid", "v"), "v").select(*KEY, (F.col("pos") + 1).alias("pos"), "id")
    return heads.unionByName(p.join(ids.withColumnRenamed("sid", "a"), "a").select(*KEY, F.lit(0).cast("long").alias("pos"), "id"))


def _traced(arcs: DataFrame, found: DataFrame, ties: DataFrame, ends: DataFrame) -> DataFrame:
    """(run_id, comp, sid, pos): states on the way from the starts of the labels `found` to the ends (run_id, comp, slot, sid); pos counts from the start.

    A state's predecessor is that of the smallest tie among those whose cost and arc make up its own cost. Pointers over 2^i predecessors are tables;
    the path is all that is found from the end by any sum of them.
    """
    at = found.select("slot", "sid", "cost")
    a = at.join(ties, "sid").select("slot", F.col("sid").alias("a"), F.col("cost").alias("ca"), "tie")
    b = at.select("slot", F.col("sid").alias("b"), F.col("cost").alias("cb"))
    fits = arcs.join(a, "a").join(b, ["slot", "b"]).where((F.col("ca") < F.col("cb")) & (F.abs(F.col("ca") + F.col("cost") - F.col("cb")) <= 1e-9 * (1 + F.col("cb") * 1e-3)))
    up = fits.groupBy("slot", "b").agg(F.min(F.struct("tie", "a")).alias("m")).select("slot", F.col("b").alias("sid"), F.col("m.a").alias("to"))
    path = iterate.along_pointers(up, ends.select(*KEY, "slot", "sid"), ["slot"], "sid", "to", "path")
    size = path.groupBy(*KEY, "slot").agg(F.max("steps").alias("last"))
    return path.join(size, [*KEY, "slot"]).select(*KEY, "sid", (F.col("last") - F.col("steps")).alias("pos"))


def far_pairs(net: Network, among: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(run_id, comp, slot, a, b, cost): pairs of far nodes by length, among the given nodes of each component.

    The first seed is the node of least degree; each next one is farthest from all seeds before. A seed's pair is the
    node farthest from it, and the node farthest from that. Slots number the seeds; equal pairs of several seeds stay.
    """
    g = net.graph(True)
    degree = net.halves.groupBy(F.col("u").alias("sid")).agg(F.count("*").alias("degree"))
    first = among.join(degree, "sid", "left").groupBy(*KEY).agg(F.min(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "id", "sid")).alias("m"))
    seed = first.select(*KEY, F.lit(0).alias("slot"), "m.sid")
    least, tops = None, None
    for k in range(max(1, seeds - 1)):
        d = reached(g, among, seed).select(*KEY, "slot", "sid", "id", "cost", "steps")
        if k:
            # the first start of a slot is a seed; distances to the nearest seed go on
            d = iterate.cut(d.join(least.select("sid", F.col("least").alias("before")), "sid").withColumn("least", F.least("cost", "before")).drop("before"), "seeds")
        else:
            d = iterate.cut(d.withColumn("least", F.col("cost")), "seeds")
        a = _best(d).select(*KEY, F.lit(k).alias("slot"), "sid")
        tops = a if tops is None else tops.unionByName(a)
        seed = iterate.cut(_best(d, "least").select(*KEY, F.lit(0).alias("slot"), "sid"), "seed")
        least = d
    tops = iterate.cut(tops, "tops")
    b = farthest(g, net.nodes, tops, among)
    return iterate.cut(tops.select(*KEY, "slot", F.col("sid").alias("a")).join(b.select(*KEY, "slot", F.col("sid").alias("b"), "cost"), [*KEY, "slot"]), "far_pairs")


def tree_diameters(net: Network, points: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, comp, a, b, length): ends of the longest path in each component's maximum spanning tree, and their shortest length on the graph."""
    e = graph.edge_gaps(points, graph.dedup_edges(edges)).select("run_id", "u", "v", F.round("d", 9).alias("w"))
    tree = graph.spanning_forest(e, largest=True)
    t = two_sweeps(Network(net.nodes, _halves(net.nodes, tree)).graph(True), net.nodes)
    on = reached(net.graph(True), net.nodes, t.select(F.lit(0).alias("slot"), F.col("a").alias("sid")))
    return t.join(on.select(F.col("sid").alias("b"), F.col("cost").alias("length")), "b").select(*KEY, "a", "b", "length")


def _axis_ends(nodes: DataFrame) -> DataFrame:
    """(run_id, comp, a, b): the nodes at the ends of the first principal axis of each component's nodes."""
    m = nodes.groupBy(*KEY).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = nodes.join(m, KEY).withColumns({"cx": F.col("x") - F.col("mx"), "cy": F.col("y") - F.col("my")})
    s = d.groupBy(*KEY).agg(F.sum(F.col("cx") * F.col("cx")).alias("xx"), F.sum(F.col("cy") * F.col("cy")).alias("yy"), F.sum(F.col("cx") * F.col("cy")).alias("xy"))
    t = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    p = d.join(s.select(*KEY, t.alias("t")), KEY).withColumn("along", F.round(F.col("cx") * F.cos("t") + F.col("cy") * F.sin("t"), 9))
    ends = p.groupBy(*KEY).agg(F.min(F.struct("along", "id", "sid")).alias("lo"), F.min(F.struct((-F.col("along")).alias("less"), "id", "sid")).alias("hi"))
    return ends.select(*KEY, F.col("lo.sid").alias("a"), F.col("hi.sid").alias("b"))


def geometric_backbones(net: Network, edges: DataFrame, lam: float = 0.5, seeds: int = SEEDS) -> DataFrame:
    """(run_id, comp, length, steps) of the longest turn-aware path by length between the ends of the principal axis, far pairs and the farthest pair of
    the 2-core's nodes. Where the core has at most one node: the shortest path between the component's farthest pair."""
    nodes, _ = core_nodes(net, edges)
    slim = net.nodes.join(nodes.select(*KEY).distinct(), KEY, "left_anti")
    g = net.graph(True)
    far = two_sweeps(g, net.nodes, slim).select(*KEY, F.col("cost").alias("length"), "steps")
    axis = _axis_ends(nodes).select(*KEY, F.lit(0).alias("slot"), "a", "b")
    pairs = far_pairs(net, nodes, seeds).select(*KEY, (F.col("slot") + 1).alias("slot"), "a", "b")
    ends = two_sweeps(g, net.nodes, nodes).select(*KEY, F.lit(seeds + 1).alias("slot"), "a", "b")
    asked = iterate.cut(axis.unionByName(pairs).unionByName(ends), "asked")
    # equal pairs are searched once
    asked = asked.groupBy(*KEY, "a", "b").agg(F.min("slot").alias("slot"))
    t = turn_aware(net, asked, lam, by_length=True)
    best = t.groupBy(*KEY).agg(F.min(F.struct((-F.round("length", 9)).alias("less"), "slot", "length", "steps")).alias("m")).select(*KEY, "m.length", "m.steps")
    return best.unionByName(far)


def _packed_pairs(p: packed.Pack, among: np.ndarray | None, seeds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, cost) by component of a pack for every slot of far_pairs()."""
    seed, least, out = p.top(-np.diff(p.begin).astype(float), among, None), None, []
    for _ in range(max(1, seeds - 1)):
        d = p.from_nodes(seed, True)[0]
        least = d if least is None else np.where(np.isfinite(least) & np.isfinite(d), np.minimum(least, d), np.inf)
        a, seed = p.top(d, among), p.top(least, among)
        b, cost, new = np.full(len(a), -1), np.full(len(a), -np.inf), a >= 0
        for before in out:  # a node that was one seed's farthest before is not searched from again
            same = before[0] == a
            b, cost, new = np.where(same, before[1], b), np.where(same, before[2], cost), new & ~same
        d = p.from_nodes(np.where(new, a, -1), True)[0]
        far = p.top(d, among)
        found = np.flatnonzero(new & (far >= 0))
        b[found], cost[found] = far[found], d[far[found]]
        out.append((a, b, cost))
    return out


def _packed_axis(p: packed.Pack, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of _axis_ends() by component of a pack, -1 where it has none of the nodes; places count from the component's first node."""
    g, k = p.group[among], len(p.first)
    x, y = p.x - p.x[p.first][p.group], p.y - p.y[p.first][p.group]
    n = np.maximum(np.bincount(g, minlength=k), 1)
    cx, cy = x - (np.bincount(g, x[among], k) / n)[p.group], y - (np.bincount(g, y[among], k) / n)[p.group]
    xx, yy, xy = (np.bincount(g, v[among], k) for v in (cx * cx, cy * cy, cx * cy))
    t = (0.5 * np.arctan2(2 * xy, xx - yy))[p.group]
    along = cx * np.cos(t) + cy * np.sin(t)
    return p.top(-along, among), p.top(along, among)


def _packed_longest(p: packed.Pack, lam: float, seeds: int) -> dict:
    """The rows of longest_paths() for a pack, before rounding; all by the rules of far_pairs(), tree_diameters() and geometric_backbones()."""
    a, b, labels = p.sweeps(True)
    far, steps = labels[0][b], labels[1][b]
    best = np.max([cost for _, _, cost in _packed_pairs(p, None, seeds)], axis=0)
    ta, tb, _ = p.only(p.largest_tree()).sweeps(True)
    tree = p.from_nodes(ta, True)[0][tb]
    core = p.core()
    bone, nodes, top = far.copy(), steps + 1, np.where(p.top(np.zeros(p.n), core) >= 0, -np.inf, np.inf)
    turns = packed.Turns(p, lam, True)
    ends = p.sweeps(True, core)[:2]
    asked: list = []
    for s, t in [_packed_axis(p, core), *[pair[:2] for pair in _packed_pairs(p, core, seeds)], ends]:
        new = (s >= 0) & (t >= 0)
        for x, y in asked:  # equal pairs are searched once
            new &= (x != s) | (y != t)
        asked.append((s, t))
        new = np.flatnonzero(new)
        _, hops, length = turns.ways(s[new], t[new])
        longer = np.round(length, 9) > top[new]
        at = new[longer]
        top[at], bone[at], nodes[at] = np.round(length[longer], 9), length[longer], hops[longer] + 1
    some = np.flatnonzero(steps > 0)
    sizes = {"far_length": far, "best_length": best, "tree_length": tree, "backbone_length": bone}
    return _keys(p, some) | {"a": p.ids[a[some]], "b": p.ids[b[some]]} | {k: v[some] for k, v in sizes.items()} | {"backbone_nodes": nodes[some].astype(np.int64)}


def longest_paths(points: DataFrame, edges: DataFrame, comps: DataFrame, lam: float = 0.5, seeds: int = SEEDS) -> DataFrame:
    """Lengths by component with edges: farthest pair, best of the far pairs, spanning-tree diameter on the graph, and the geometric backbone."""
    small, large, between = packed.parted(edges, comps)
    sizes = ["far_length", "best_length", "tree_length", "backbone_length"]
    out = packed.solved(points, edges, small, lambda p: _packed_longest(p, lam, seeds), f"run_id long, comp long, a long, b long, {', '.join(f'{c} double' for c in sizes)}, backbone_nodes long")
    out = out.withColumns({c: F.round(c, 6) for c in sizes})
    if large is None:
        return out
    net = network(points, between, large)
    far = two_sweeps(net.graph(True), net.nodes).where("steps > 0").select(*KEY, F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("cost", 6).alias("far_length"))
    best = far_pairs(net, net.nodes, seeds).groupBy(*KEY).agg(F.round(F.max("cost"), 6).alias("best_length"))
    tree = tree_diameters(net, points, between).select(*KEY, F.round("length", 6).alias("tree_length"))
    bone = geometric_backbones(net, between, lam, seeds).select(*KEY, F.round("length", 6).alias("backbone_length"), (F.col("steps") + 1).cast("long").alias("backbone_nodes"))
    return out.unionByName(far.join(best, KEY).join(tree, KEY).join(bone, KEY).select(out.columns))
