"""Packs of small components against the plain searches of test_paths.py: the same rules as by tiles, in one table of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from test_paths import LAM, PLAIN, SHAPES, tables  # noqa: F401

from strandlake.operators import paths
from strandlake.plans import iterate, packed


@pytest.fixture
def cuts(monkeypatch):
    """Tables that a query writes on its way."""
    seen = []
    monkeypatch.setattr(iterate, "cut", lambda df, name, *a, _=iterate.cut: seen.append(name) or _(df, name, *a))
    return seen


@pytest.mark.parametrize("by_length", [False, True])
def test_turn_aware_costs(spark, tables, cuts, by_length):  # noqa: F811
    got = {r.run_id: r for r in paths.turn_aware_costs(*tables, lam=LAM, by_length=by_length).collect()}
    assert cuts == ["large"] and len(got) == len(PLAIN)
    for r, g in enumerate(PLAIN):
        a, b, _ = g.sweep()
        cost, hops, _ = g.turn_aware(a, b, by_length)
        assert (got[r].a, got[r].b, got[r].hops) == (a, b, hops) and got[r].cost == pytest.approx(cost, abs=2e-6)


@pytest.mark.parametrize("mode,peel", [("geodesic", True), ("turnaware", False), ("both", True)])
def test_backbone_nodes(tables, cuts, mode, peel):  # noqa: F811
    rows: dict = {}
    for r in paths.backbone_nodes(*tables, mode=mode, lam=LAM, peel=peel).collect():
        assert r.pos not in rows.setdefault((r.run_id, r.comp), {})
        rows[r.run_id, r.comp][r.pos] = r.id
    assert cuts == ["large"] and len(rows) == 2 * len(PLAIN)
    for r, g in enumerate(PLAIN):
        assert rows[r, g.n] == {0: g.n}
        a, b, hops = g.sweep()
        if mode != "geodesic":
            core = g.core() if peel else set()
            ends = g.sweep(core)[:2] if len(core) > 1 and {a, b} <= core else (a, b)
            turned = g.turn_aware(*ends, False)[1]
            if mode == "turnaware" or turned > hops:
                (a, b), hops = ends, turned
        path = rows[r, 0]
        assert sorted(path) == list(range(hops + 1)) and (path[0], path[hops]) == (a, b)
        assert all(tuple(sorted((path[k], path[k + 1]))) in set(SHAPES[r][1]) for k in range(hops))


def test_longest_paths(tables, cuts):  # noqa: F811
    got = {r.run_id: r for r in paths.longest_paths(*tables, lam=LAM, seeds=4).collect()}
    assert cuts == ["large"] and len(got) == len(PLAIN)
    for r, g in enumerate(PLAIN):
        a, b = g.far(range(g.n))
        assert (got[r].a, got[r].b) == (a, b) and got[r].far_length == pytest.approx(g.d[a, b], abs=2e-6)
        assert got[r].best_length == pytest.approx(max(g.d[s, t] for s, t in g.far_pairs(range(g.n), 4)), abs=2e-6)
        s, t = g.tree_ends()
        assert got[r].tree_length == pytest.approx(g.d[s, t], abs=2e-6)
        bone = g.geometric_backbone(4)
        assert any(got[r].backbone_length == pytest.approx(x, abs=2e-6) for x in (bone if isinstance(bone, set) else [bone]))


def test_large_and_crowded_components_go_by_tiles(spark):
    """A chain of 3000 nodes, a star of 200 leaves and a pair: only the pair fits into a pack, and no path is lost."""
    e = spark.createDataFrame([(0, i, i + 1) for i in range(2999)] + [(1, 0, i) for i in range(1, 201)] + [(2, 5, 6)], "run_id long, u long, v long")
    rows = [(0, i, float(i), 0.0) for i in range(3000)] + [(1, i, float(np.cos(i)), float(np.sin(i)) * i) for i in range(201)] + [(2, 5, 0.0, 0.0), (2, 6, 1.0, 0.0)]
    p = spark.createDataFrame(rows, "run_id long, id long, x double, y double")
    comps = p.selectExpr("run_id", "id", "case when run_id = 2 then 5L else 0L end as comp")
    small, large, between = packed.parted(e, comps)
    assert {r.run_id for r in small.collect()} == {2} and {r.run_id for r in large.collect()} == {0, 1} and between.count() == 3199
    got = {r.run_id: (r.a, r.b, r.hops) for r in paths.turn_aware_costs(p, e, comps).collect()}
    assert got == {0: (2999, 0, 2999), 1: (1, 2, 2), 2: (6, 5, 1)}


def test_packs_hold_whole_components(monkeypatch):
    """Repeated edges, loops, edges to unknown nodes and edges of a component without nodes; components of several runs and over batches."""
    monkeypatch.setattr(packed, "ROWS", 25)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for run in range(3):
        for comp in range(0, 400, 40):
            ids = np.sort(rng.choice(39, rng.integers(1, 12), replace=False) + comp).tolist()
            pairs = [tuple(rng.choice(ids, 2).tolist()) for _ in range(rng.integers(0, 15))]
            rows += [(run, comp, 0, i, 0, float(i), 0.0) for i in ids] + sorted((run, comp, 1, u, v, 0.0, 0.0) for u, v in [*pairs, *pairs[:2], (ids[0], comp + 39)])
            want[run, comp] = ids, {tuple(sorted(x)) for x in pairs if x[0] != x[1]}
        rows.append((run, 999, 1, 1000, 1001, 0.0, 0.0))
    t = pa.Table.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["run_id", "comp", "kind", "a", "b", "x", "y"])
    got, n = {}, 0
    for p in packed.packs(iter(t.to_batches(max_chunksize=7))):
        n += 1
        for k in range(len(p.first)):
            assert (p.run[k], p.comp[k]) not in got
            mine = p.group[p.u] == k
            got[p.run[k], p.comp[k]] = p.ids[p.group == k].tolist(), set(zip(p.ids[p.u[mine]].tolist(), p.ids[p.v[mine]].tolist()))
    assert got == want and n > 5


def test_trees_of_a_pack_are_spanning_forests():
    """Against Kruskal's rule, with many equal lengths."""
    rng = np.random.default_rng(5)
    at = rng.integers(0, 4, (60, 2)).astype(float)
    pairs = sorted({tuple(sorted(rng.choice(60, 2, replace=False).tolist())) for _ in range(110)})
    rows = [(0, 0, 0, i, 0, *at[i]) for i in range(60)] + [(0, 0, 1, u, v, 0.0, 0.0) for u, v in pairs]
    p = packed.Pack(pa.Table.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["run_id", "comp", "kind", "a", "b", "x", "y"]))
    root, want = list(range(60)), set()
    for _, u, v in sorted((-round(float(np.hypot(*(at[u] - at[v]))), 9), u, v) for u, v in pairs):
        if root[u] != root[v]:
            want.add((u, v))
            root = [root[u] if x == root[v] else x for x in root]
    tree = p.largest_tree()
    assert set(zip(p.u[tree].tolist(), p.v[tree].tolist())) == want
