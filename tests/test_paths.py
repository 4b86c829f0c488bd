"""Sweeps, shortest paths, far pairs and backbones against plain searches, over tiles of a few nodes; one component of many tiles."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import graph, paths
from strandlake.plans import iterate, tiled

LAM = 0.5
PENALTY = 0.5 * math.pi**2 * LAM


def random_graph(seed, n=14, m=21):
    rng = random.Random(seed)
    xy = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(n)]
    return xy, sorted({(i - 1, i) for i in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m - n)})


def random_tree(seed, n=12):
    rng = random.Random(seed)
    return [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(n)], sorted((rng.randrange(i), i) for i in range(1, n))


def lollipop():
    """A ring with a long tail: the tail's end is outside of the core."""
    xy = [(math.cos(k), math.sin(k)) for k in range(6)] + [(2.0 + k, 0.3 * (k % 2)) for k in range(7)]
    return xy, sorted([(k, (k + 1) % 6) if k < 5 else (0, 5) for k in range(6)] + [(0, 6)] + [(k, k + 1) for k in range(6, 12)])


def two_rings():
    """Straight strands with rings at both ends: the sweep's ends are in the core."""
    xy = [(math.cos(2.1 * k), math.sin(2.1 * k)) for k in range(3)] + [(3.0, 0.2), (4.0, -0.1), (5.0, 0.0)] + [(7 + math.cos(2.1 * k + 2), math.sin(2.1 * k + 2)) for k in range(3)]
    return xy, [(0, 1), (0, 2), (0, 3), (1, 2), (3, 4), (4, 5), (5, 6), (6, 7), (6, 8), (7, 8)]


SHAPES = [random_graph(s) for s in (1, 2, 3, 4, 5, 6)] + [random_tree(7), random_tree(8), lollipop(), two_rings()]


class Plain:
    """One connected graph with dictionaries; rules as documented, ties to the smallest id."""

    def __init__(self, xy, edges):
        self.xy, self.edges, self.n = xy, edges, len(xy)
        self.near = {i: sorted({b if a == i else a for a, b in edges if i in (a, b)}) for i in range(self.n)}
        self.length = lambda i, j: math.dist(xy[i], xy[j])
        self.d = np.full((self.n, self.n), np.inf)
        self.d[range(self.n), range(self.n)] = 0
        for u, v in edges:
            self.d[u, v] = self.d[v, u] = self.length(u, v)
        for k in range(self.n):
            self.d = np.minimum(self.d, self.d[:, k, None] + self.d[None, k])

    def hops(self, start, inside=None):
        inside = range(self.n) if inside is None else inside
        dist, queue = {start: 0}, [start]
        for i in queue:
            for j in self.near[i]:
                if j in inside and j not in dist:
                    dist[j] = dist[i] + 1
                    queue.append(j)
        return dist

    @staticmethod
    def top(dist):
        return min(dist, key=lambda i: (-round(dist[i], 9), i))

    def sweep(self, inside=None):
        a = self.top(self.hops(min(inside or [0]), inside))
        back = self.hops(a, inside)
        b = self.top(back)
        return a, b, back[b]

    def core(self):
        left = set(range(self.n))
        while gone := {i for i in left if sum(j in left for j in self.near[i]) <= 1}:
            left -= gone
        return left

    def far(self, among):
        a = self.top({i: self.d[min(among), i] for i in among})
        b = self.top({i: self.d[a, i] for i in among})
        return a, b

    def turn_aware(self, s, t, by_length):
        """(cost, steps, length) of the cheapest way, by relaxing half-edges until nothing changes."""
        if s == t:
            return 0.0, 0, 0.0
        step = (lambda i, j: self.length(i, j)) if by_length else (lambda i, j: 1.0)
        best = {(s, j): (step(s, j), 1, self.length(s, j)) for j in self.near[s]}
        moved = True
        while moved:
            moved = False
            for (i, j), (c, h, size) in list(best.items()):
                for k in self.near[j]:
                    x, y = np.subtract(self.xy[j], self.xy[i]), np.subtract(self.xy[k], self.xy[j])
                    cos = max(-1.0, min(1.0, float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))))
                    new = c + step(j, k) + PENALTY * (1 - cos)
                    if new < best.get((j, k), (math.inf,))[0] - 1e-12:
                        best[j, k] = (new, h + 1, size + self.length(j, k))
                        moved = True
        return min(v for (_, j), v in best.items() if j == t)

    def far_pairs(self, among, seeds=8):
        among = sorted(among)
        chosen, pairs = [min(among, key=lambda i: (len(self.near[i]), i))], []
        for _ in range(seeds):
            a = self.top({i: self.d[chosen[-1], i] for i in among})
            pairs.append((a, self.top({i: self.d[a, i] for i in among})))
            chosen.append(self.top({i: min(self.d[s, i] for s in chosen) for i in among}))
            if len(chosen) >= seeds:
                return pairs
        return pairs

    def tree_ends(self):
        root, t = list(range(self.n)), np.full((self.n, self.n), np.inf)
        t[range(self.n), range(self.n)] = 0
        for _, u, v in sorted((-round(self.length(u, v), 9), u, v) for u, v in self.edges):
            if root[u] != root[v]:
                root = [root[u] if x == root[v] else x for x in root]
                t[u, v] = t[v, u] = self.length(u, v)
        for k in range(self.n):
            t = np.minimum(t, t[:, k, None] + t[None, k])
        s = self.top(dict(enumerate(t[0])))
        return s, self.top(dict(enumerate(t[s])))

    def geometric_backbone(self, seeds):
        core = self.core()
        if len(core) <= 1:
            a, b = self.far(range(self.n))
            return self.d[a, b]
        at = np.array([self.xy[i] for i in sorted(core)])
        at = at - at.mean(0)
        along = at @ np.linalg.eigh(at.T @ at)[1][:, -1]
        ends = [sorted(core)[int(k)] for k in (along.argmin(), along.argmax())]
        sizes = [self.turn_aware(s, t, True)[2] for s, t in [ends, ends[::-1], *self.far_pairs(core, seeds), self.far(core)]]
        # the axis has no direction: either way round may be searched
        return {round(max([x, *sizes[2:]]), 6) for x in sizes[:2]}


PLAIN = [Plain(*s) for s in SHAPES]


@pytest.fixture(scope="module")
def tables(spark):
    """All shapes as runs of one table, with an isolated node in each; components have a few nodes for each tile."""
    p = spark.createDataFrame([(r, i, *q) for r, (xy, _) in enumerate(SHAPES) for i, q in enumerate([*xy, (50.0, 50.0)])], "run_id long, id long, x double, y double")
    e = spark.createDataFrame([(r, u, v) for r, (_, edges) in enumerate(SHAPES) for u, v in [*edges, edges[0], edges[1][::-1]]], "run_id long, u long, v long")
    return p, e, iterate.cut(graph.components(p, e), "comps")


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiled, "TILE", 100)


def test_distances(spark, tables):
    got = {(r.run_id, r.id): r.dist for r in paths.distances(*tables).collect()}
    want = {(r, i): d for r, g in enumerate(PLAIN) for i, d in g.hops(0).items()} | {(r, g.n): 0 for r, g in enumerate(PLAIN)}
    assert got == want


def test_lengths_from_several_starts(spark, tables):
    starts = spark.createDataFrame([(r, i) for r in range(4) for i in (3, 1, 1, 7)], "run_id long, id long")
    got = {(r.run_id, r.start, r.id): r.length for r in paths.lengths(*tables, starts).collect()}
    assert got.keys() == {(r, s, i) for r in range(4) for s in (1, 3, 7) for i in range(PLAIN[r].n)}
    assert all(v == pytest.approx(PLAIN[r].d[s, i], abs=1e-9) for (r, s, i), v in got.items())


@pytest.mark.parametrize("by_length", [False, True])
def test_turn_aware_costs(spark, tables, by_length):
    got = {r.run_id: r for r in paths.turn_aware_costs(*tables, lam=LAM, by_length=by_length).collect()}
    assert len(got) == len(PLAIN)
    for r, g in enumerate(PLAIN):
        a, b, _ = g.sweep()
        cost, hops, _ = g.turn_aware(a, b, by_length)
        assert (got[r].a, got[r].b, got[r].hops) == (a, b, hops) and got[r].cost == pytest.approx(cost, abs=2e-6)


@pytest.mark.parametrize("mode,peel", [("geodesic", True), ("turnaware", False), ("both", True)])
def test_backbones(spark, tables, mode, peel):
    p, e, c = tables
    inside = 0
    want = {}
    for r, g in enumerate(PLAIN):
        a, b, hops = g.sweep()
        want[r] = a, b, hops
        if mode != "geodesic":
            core = g.core() if peel else set()
            if len(core) > 1 and {a, b} <= core:
                a, b, _ = g.sweep(core)
                inside += 1
            turned = g.turn_aware(a, b, False)[1]
            if mode == "turnaware" or turned > hops:
                want[r] = a, b, turned
    assert inside > 0 or mode == "geodesic" or not peel
    got = paths.backbones(p, e, c, mode=mode, lam=LAM, peel=peel).collect()
    assert {r.run_id: (r.a, r.b, r.hops) for r in got if r.comp == 0} == want
    assert all((r.a, r.b, r.hops) == (r.comp, r.comp, 0) for r in got if r.comp > 0) and len(got) == 2 * len(PLAIN)
    if mode == "geodesic" or not peel:
        return
    nodes: dict = {}
    for r in paths.backbone_nodes(p, e, c, mode=mode, lam=LAM, peel=peel).collect():
        nodes.setdefault((r.run_id, r.comp), {})[r.pos] = r.id
    for r, (a, b, hops) in want.items():
        path = nodes[r, 0]
        assert sorted(path) == list(range(hops + 1)) and (path[0], path[hops]) == (a, b)
        assert all(tuple(sorted((path[k], path[k + 1]))) in set(SHAPES[r][1]) for k in range(hops))


def test_unknown_mode(tables):
    with pytest.raises(ValueError, match="mode"):
        paths.backbones(*tables, mode="other")


def test_longest_paths(spark, tables):
    seeds = 4
    got = {r.run_id: r for r in paths.longest_paths(*tables, lam=LAM, seeds=seeds).collect()}
    assert len(got) == len(PLAIN)
    for r, g in enumerate(PLAIN):
        a, b = g.far(range(g.n))
        assert (got[r].a, got[r].b) == (a, b) and got[r].far_length == pytest.approx(g.d[a, b], abs=2e-6)
        assert got[r].best_length == pytest.approx(max(g.d[s, t] for s, t in g.far_pairs(range(g.n), seeds)), abs=2e-6)
        s, t = g.tree_ends()
        assert got[r].tree_length == pytest.approx(g.d[s, t], abs=2e-6)
        bone = g.geometric_backbone(seeds)
        assert any(got[r].backbone_length == pytest.approx(x, abs=2e-6) for x in (bone if isinstance(bone, set) else [bone]))


def test_no_edges_and_no_points(spark, tables):
    p, e, c = tables
    none = e.limit(0)
    alone = graph.components(p, none)
    assert {r.dist for r in paths.distances(p, none, alone).collect()} == {0}
    assert paths.turn_aware_costs(p, none, alone).count() == 0
    assert paths.distances(p.limit(0), none, c.limit(0)).count() == 0


def test_one_component_of_many_tiles(spark, monkeypatch):
    """A sheet of 40,000 nodes in some 20 tiles: steps are the sums of the coordinates, and so is the path's length."""
    monkeypatch.setattr(tiled, "TILE", 2000)
    m = 200
    i = spark.range(m * m)
    run = F.lit(0).cast("long").alias("run_id")
    p = i.select(run, "id", (F.col("id") % m).cast("double").alias("x"), F.expr(f"id div {m}").cast("double").alias("y"))
    right = i.where(f"id % {m} < {m - 1}").select(run, F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    e = right.union(i.where(f"id < {m * (m - 1)}").select(run, F.col("id").alias("u"), (F.col("id") + m).alias("v")))
    net = paths.network(p, e, p.select("run_id", "id", F.lit(0).cast("long").alias("comp")))
    sizes = net.nodes.groupBy(F.shiftright("sid", 33)).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 8000 and sizes[1] > 12
    found = paths.reached(net.graph(), net.nodes, paths._smallest(net.nodes))
    assert found.count() == m * m and found.where(f"cost <> id % {m} + id div {m} or steps <> cost").count() == 0
    assert [(r.a_id, r.b_id, r.steps) for r in paths.two_sweeps(net.graph(), net.nodes).collect()] == [(m * m - 1, 0, 2 * (m - 1))]
