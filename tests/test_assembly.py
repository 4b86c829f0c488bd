"""Hand fixtures, brute force and invariants of the assembly operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import faces, graph, growth, labels, matrix, raster, spatial, stats, voronoi

SQUARE = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0), (4, 0.0, 1.0)]
RING = [(1, 2), (2, 3), (3, 4), (1, 4)]


def points(spark, rows):
    return spark.createDataFrame([(0, i, float(x), float(y)) for i, x, y in rows], "run_id long, id long, x double, y double")


def edges(spark, rows):
    return spark.createDataFrame([(0, u, v) for u, v in rows], "run_id long, u long, v long")


def areas_of(spark, p, e, **kw):
    return sorted(r["area"] for r in faces.enclosed(faces.loops(points(spark, p), edges(spark, e))[1], **kw).collect())


def test_unit_square(spark):
    assert areas_of(spark, SQUARE, RING) == pytest.approx([1.0], abs=1e-12)


def test_edges_to_unknown_nodes_are_dropped_with_a_warning(spark):
    with pytest.warns(UserWarning, match="2 edges to unknown nodes dropped"):
        got = areas_of(spark, SQUARE, [*RING, (4, 99), (98, 99)])
    assert got == pytest.approx([1.0], abs=1e-12)


def test_net_areas_of_deep_nesting(spark):
    rows = [(0, i, i + 1, 100.0 - i, i - 1 if i else None, i if i else None) for i in range(40)] + [(0, 500, 501, 7.0, None, None), (1, 0, 1, 3.0, None, None)]
    n = spark.createDataFrame(rows, "run_id long, u long, v long, area double, parent_u long, parent_v long")
    got = {(r["run_id"], r["u"]): r["net"] for r in faces.net_areas(n).collect()}
    assert got == {(0, 0): pytest.approx(20.0), (0, 500): 7.0, (1, 0): 3.0}
    assert faces.net_areas(n.limit(0)).count() == 0


def test_square_with_diagonal(spark):
    assert areas_of(spark, SQUARE, [*RING, (2, 4)]) == pytest.approx([0.5, 0.5], abs=1e-12)


def test_nested_squares_leave_an_annulus(spark):
    p = [(1, 0, 0), (2, 2, 0), (3, 2, 2), (4, 0, 2), (5, 0.5, 0.5), (6, 1.5, 0.5), (7, 1.5, 1.5), (8, 0.5, 1.5)]
    e = [*RING, (5, 6), (6, 7), (7, 8), (5, 8)]
    pf, ef = points(spark, p), edges(spark, e)
    named, found = faces.loops(pf, ef)
    net = faces.net_areas(faces.nesting(pf, named, found, graph.components(pf, ef))).collect()
    assert [r["net"] for r in net] == pytest.approx([3.0], abs=1e-12)
    assert sum(r["area"] for r in found.collect()) == pytest.approx(0.0, abs=1e-12)


def test_per_component_outer_faces(spark):
    p = SQUARE + [(i + 4, x + 5, y) for i, x, y in SQUARE]
    e = RING + [(u + 4, v + 4) for u, v in RING]
    pf, ef = points(spark, p), edges(spark, e)
    found = faces.loops(pf, ef)[1]
    assert faces.enclosed(found).count() == 3
    assert faces.enclosed(found, drop_outer="per_component", points_comp=graph.components(pf, ef)).count() == 2
    with pytest.raises(ValueError):
        faces.enclosed(found, drop_outer="none")


def test_faces_far_from_the_origin_keep_their_digits(spark):
    """Copies of a ring with a tail and of a tree, moved by multiples of a power of two: the same areas and centroids, and flat loops stay flat."""
    p, e, moves = [], [], [0.0, 2.0**20, 2.0**27]
    shape = [(0.125, 0.25), (1.5, 0.375), (1.25, 1.75), (0.25, 1.5), (2.125, 0.5), (3.375, 0.25), (6.0, 0.75), (7.25, 1.625), (8.5, 0.25), (7.75, 3.0), (9.125, 2.875)]
    for k, far in enumerate(moves):
        p += [(i + 20 * k, x + far, y + 3 * far) for i, (x, y) in enumerate(shape)]
        e += [(u + 20 * k, v + 20 * k) for u, v in [(0, 1), (1, 2), (2, 3), (0, 3), (1, 4), (4, 5), (6, 7), (7, 8), (7, 9), (9, 10)]]
    pf, ef = points(spark, p), edges(spark, e)
    named, found = faces.loops(pf, ef)
    got = {r["u"]: (r["area"], r["cx"], r["cy"]) for r in faces.centroids(pf, named, found.where("area > 1e-9")).collect()}
    assert len(got) == 3 and got[0][0] > 1
    for k, far in enumerate(moves):
        area, cx, cy = got[20 * k]
        assert area == pytest.approx(got[0][0], abs=1e-12) and (cx - far, cy - 3 * far) == pytest.approx(got[0][1:], abs=1e-6)
    assert sorted(r["area"] for r in found.where("u % 20 >= 6").collect()) == pytest.approx([0.0] * 3, abs=1e-12)


def test_trimer_contacts(spark):
    p = points(spark, [(1, 0.0, 0.0), (2, 0.4, 0.0), (3, 0.2, 0.2 * math.sqrt(3))])
    assert spatial.contact_edges(p, radius=0.2).count() == 3
    d = {r["id"]: r["degree"] for r in graph.degrees(p, edges(spark, [(1, 2), (2, 3)])).collect()}
    assert d == {1: 1, 2: 2, 3: 1}


def test_contacts_match_brute_force_also_with_negative_places(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(200)] + [(900, float("nan"), 0.0), (901, float("inf"), 0.0)]
    got = {(r["u"], r["v"]) for r in spatial.contact_edges(points(spark, rows), radius=1.0).collect()}
    want = {(a, b) for a, x, y in rows for b, u, v in rows if a < b and math.hypot(x - u, y - v) <= 2.04}
    assert got == want


def test_nearest_other_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 20), rng.gauss(0, 20)) for i in range(120)] + [(500, 4000.0, 4000.0)]
    got = {r["id"]: r["distance"] for r in spatial.nearest_other(points(spark, rows)).collect()}
    assert got == pytest.approx({a: min(math.hypot(x - u, y - v) for b, u, v in rows if a != b) for a, x, y in rows})
    assert spatial.nearest_other(points(spark, [(1, 0.0, 0.0)])).first()["distance"] is None


def test_cycle_is_one_closed_segment(spark):
    seg = graph.segments(edges(spark, [(1, 2), (2, 3), (1, 3), (7, 8), (8, 9)]))
    rows = sorted((r["seg"], r["pos"], r["id"]) for r in seg.collect())
    assert rows == [("1-2", 0, 1), ("1-2", 1, 2), ("1-2", 2, 3), ("1-2", 3, 1), ("7-8", 0, 7), ("7-8", 1, 8), ("7-8", 2, 9)]


def test_turnings_keep_their_distance(spark):
    zigzag = [(i, float(i), float(i % 2) * 3) for i in range(8)]
    p, e = points(spark, zigzag), edges(spark, [(i, i + 1) for i in range(7)])
    got = sorted(r["pos"] for r in graph.segment_turnings(p, graph.segments(e), 60.0, gap=2).collect())
    assert got == [1, 3, 5]


def test_strict_edges_refuse_loops(spark):
    e = edges(spark, [(1, 1), (2, 1), (1, 2)])
    assert [(r["u"], r["v"]) for r in graph.dedup_edges(e).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="self-loop"):
        graph.dedup_edges(e, strict=True).collect()


def _kruskal(e, sign):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = 0.0
    for w, u, v in sorted((sign * w, u, v) for u, v, w in e):
        a, b = top(u), top(v)
        if a != b:
            root[a] = b
            out += sign * w
    return out


@pytest.mark.parametrize("largest", [False, True])
def test_spanning_forest_weight(spark, largest):
    rng = random.Random(5)
    e = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a != b})
    e = [(u, v, float(rng.randrange(10))) for u, v in e]
    df = spark.createDataFrame([(0, *x) for x in e], "run_id long, u long, v long, w double")
    assert sum(r["w"] for r in graph.spanning_forest(df, largest=largest).collect()) == _kruskal(e, -1 if largest else 1)


def test_box_removal_renumbers(spark):
    rows = [(i, float(i % 5), float(i // 5)) for i in range(1, 11)] + [(50, 100.0, 100.0)]
    p, e = spatial.without_small_boxes(points(spark, rows), edges(spark, [(1, 2), (2, 50)]), least=3)
    assert sorted(r["new_id"] for r in p.collect()) == list(range(1, 11))
    assert [(r["u"], r["v"]) for r in e.collect()] == [(1, 2)]


def test_voronoi_of_a_grid(spark):
    rows = [(5 * i + j, float(i), float(j)) for i in range(5) for j in range(5)]
    got = {r["id"]: r["area"] for r in voronoi.voronoi_areas(points(spark, rows)).collect()}
    assert set(got) == {5 * i + j for i in (1, 2, 3) for j in (1, 2, 3)}
    assert list(got.values()) == pytest.approx([1.0] * 9)


@pytest.mark.parametrize("few", [2000, 0])
def test_voronoi_is_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(voronoi, "FEW", few)
    rng = np.random.default_rng(7)
    xy = np.concatenate((rng.uniform(0, 10, (50, 2)), rng.normal(60, 0.05, (20, 2)), [[30.0, 5.0]]))
    got = {r["id"]: r["area"] for r in voronoi.voronoi_areas(points(spark, [(i, *p) for i, p in enumerate(xy)])).collect()}
    want = {}
    for i, p in enumerate(xy):
        poly = np.array([(-1e7, -1e7), (1e7, -1e7), (1e7, 1e7), (-1e7, 1e7)])
        for j, q in enumerate(xy):
            if i != j:
                poly = voronoi.clip(poly, *(q - p), ((q - p) @ (q - p)) / 2)
        if np.abs(poly).max() < 0.99e7:
            q = np.roll(poly, -1, 0)
            want[i] = 0.5 * abs((poly[:, 0] * q[:, 1] - q[:, 0] * poly[:, 1]).sum())
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_voronoi_of_repeated_and_missing_places(spark):
    rows = [(5 * i + j + 10, float(i), float(j)) for i in range(5) for j in range(5)]
    p = points(spark, [*rows, (22 + 100, 2.0, 2.0), (1, 2.0, 2.0), (500, float("nan"), 1.0)]).unionByName(spark.createDataFrame([(0, 600, None, 1.0)], "run_id long, id long, x double, y double"))
    got = {r["id"]: r["area"] for r in voronoi.voronoi_areas(p).collect()}
    assert 1 in got and not {22, 122, 500, 600} & set(got) and list(got.values()) == pytest.approx([1.0] * 9)
    line = points(spark, [(i, float(i), 0.0) for i in range(6)])
    assert voronoi.voronoi_areas(line).count() == voronoi.voronoi_areas(line.limit(0)).count() == 0


def test_growth_keeps_its_invariants(spark):
    w = np.ones((72, 72))
    runs = spark.createDataFrame([(1, 101, 60), (2, 202, 60)], "run_id long, seed long, n_target long")
    g = growth.grow(runs, w).cache()
    again = growth.grow(runs, w)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(g) == key(again)
    for run in (1, 2):
        m = {r["id"]: r for r in growth.monomers(g).where(f"run_id = {run}").collect()}
        e = [(r["u"], r["v"]) for r in growth.bonds(g).where(f"run_id = {run}").collect()]
        assert len(e) == len(set(e)) and all(u < v for u, v in e)
        dist = lambda a, b: math.hypot(m[a]["x"] - m[b]["x"], m[a]["y"] - m[b]["y"])
        assert min(dist(a, b) for a in m for b in m if a < b) >= 1.9992 - 1e-9
        assert max(dist(u, v) for u, v in e) <= 2.04 + 1e-9
        assert all(m[i]["degree"] == sum(i in x for x in e) for i in m)
        k = matrix.bond_counts(growth.monomers(g), growth.bonds(g)).where(f"run_id = {run}")
        assert sum(r["k"] for r in k.collect()) == len(e)


def test_growth_takes_a_strand_back():
    a = growth.Assembly(np.ones((72, 72)), growth.Config(soft_stall=1), 7)
    a.grow(12)
    n, edges_ = len(a.x), list(a.edges)
    first = a.far_seed()
    assert first == n
    a.drop_from(first)
    assert len(a.x) == n and a.edges == edges_ and sum(map(len, a.boxes.values())) == n


def test_growth_merges_proposals_once_a_change(monkeypatch):
    """Of hundreds of rejected positions none merges the proposals again; positions and spins are drawn as numpy's choice draws them."""
    made = []
    monkeypatch.setattr(growth, "Candidates", lambda *a, _=growth.Candidates: made.append(1) or _(*a))
    a = growth.Assembly(np.ones((72, 72)), growth.Config(), 11)
    a.grow(30)
    assert len(a.x) == 30 and sum(a.rejected.values()) > 60 and len(made) <= 30
    w = np.random.default_rng(1).random(50)
    for seed in range(20):
        drawn = growth.shares(w).searchsorted(np.random.default_rng(seed).random(), side="right")
        assert drawn == np.random.default_rng(seed).choice(50, p=w / w.sum())


def test_labels(spark):
    f = spark.createDataFrame([("d/mono_hc15_N1.bin",), ("x_C9_y.bin",), ("plain.bin",)], "file string")
    assert [r["label"] for r in labels.labelled(f).collect()] == ["C15", "C9", "Other"]


def test_constant_matrix_scales_to_zero(spark):
    w = spark.createDataFrame([(r, c, 1.0) for r in range(1, 73) for c in range(1, 73)], "r int, c int, w double")
    assert {r["w"] for r in matrix.normalized(w).collect()} == {0.0}


def test_merge_rules(spark):
    c = spark.createDataFrame([(0, 1, 1, 3, 0.5, 1.0, 1.0), (0, 2, 2, 4, 0.25, 1.001, 1.0), (0, 3, 3, 5, 0.3, 9.0, 9.0)], "run_id long, parent long, seq long, r int, p double, x double, y double")
    for rule, want in (("root", math.sqrt(0.75)), ("sum", 0.75), ("product", 0.125)):
        rows = sorted(matrix.merged_candidates(c, rule=rule).collect(), key=lambda r: r["kx"])
        assert (rows[0]["p"], rows[0]["rows"], rows[0]["parent"], rows[1]["p"]) == (pytest.approx(want), [3, 4], 1, pytest.approx(0.3))


def test_ranks_count_ties_and_empty_tables(spark):
    a = spark.createDataFrame([(i, "A", 0, float(i // 2)) for i in range(50)], "id long, label string, run long, area double")
    got = {r["id"]: r["cdf"] for r in stats.count_cdf(a).collect()}
    assert got == pytest.approx({i: (i + 1) / 50 for i in range(50)})
    assert stats.count_cdf(a.limit(0)).count() == 0
    assert stats.ecdf_on_log_grid(a.limit(0)).count() == 0
    assert stats.kernel_density(a.limit(0), "area", 1.0).count() == 0


def test_kernel_density_is_the_plain_sum(spark):
    rng = np.random.default_rng(1)
    of = {"a": np.concatenate([rng.normal(0, 5, 800), [400.0], rng.normal(100, 0.01, 300)]), None: np.array([3.0, 3.0])}
    rows = [(k, float(x)) for k, v in of.items() for x in v]
    d = spark.createDataFrame([*rows, ("a", None), ("a", float("nan"))], "label string, z double")
    got = {(r["label"], r["g"]): r for r in stats.kernel_density(d, "z", 1.3, 150, pad=2.0).collect()}
    assert len(got) == 300
    for (label, _), r in got.items():
        v = of[label]
        assert r["density"] == pytest.approx(np.exp(-0.5 * ((r["x"] - v) / 1.3) ** 2).sum() / (len(v) * 1.3 * math.sqrt(2 * math.pi)), abs=1e-12)
    one = stats.kernel_density(d.where("label is null"), "z", 2.0, 3).collect()
    assert [r["density"] for r in one] == pytest.approx([1 / (2 * math.sqrt(2 * math.pi))] * 3)


def test_islands_touch_at_corners(spark):
    p = spark.createDataFrame([(0, r, c, 10 if (r, c) in {(0, 0), (1, 1), (3, 3)} else 200) for r in range(4) for c in range(4)], "img long, row long, col long, gray int")
    assert raster.islands(raster.dark(p)).select("island").distinct().count() == 2
    r = raster.island_stats(p).first()  # grown by one pixel all are one
    assert (r["islands"], r["max_area"], r["density"]) == (1, 12, 0.75)


def test_islands_over_tiles_are_flood_fills(spark):
    """Names of images as text, several tiles and large numbers of rows."""
    rng = np.random.default_rng(2)
    pictures = {"a/b.png": (rng.random((150, 140)) < 0.42, 0), "c": (rng.random((70, 200)) < 0.5, 1 << 40), "empty": (np.zeros((3, 3), bool), 0), "full": (np.ones((130, 66), bool), 0)}
    rows = [(n, int(r) + base, int(c)) for n, (m, base) in pictures.items() for r, c in zip(*np.nonzero(m))]
    got = {(r.img, r.row, r.col): (r.island.row, r.island.col) for r in raster.islands(spark.createDataFrame(rows, "img string, row long, col int")).collect()}
    want = {}
    for n, (m, base) in pictures.items():
        seen = np.zeros_like(m)
        for r, c in zip(*np.nonzero(m)):
            if seen[r, c]:
                continue
            seen[r, c], queue = True, [(r, c)]
            for i, j in queue:
                want[n, int(i) + base, int(j)] = (int(r) + base, int(c))
                for k in range(max(0, i - 1), min(m.shape[0], i + 2)):
                    for q in range(max(0, j - 1), min(m.shape[1], j + 2)):
                        if m[k, q] and not seen[k, q]:
                            seen[k, q] = True
                            queue.append((k, q))
    assert got == want


def test_long_segments_by_blocks(spark):
    """A chain of many blocks: turnings by the greedy rule, pieces, lengths and curvature as of plain loops."""
    rng = random.Random(9)
    n = 3 * graph.BLOCK + 700
    xy, a = [(0.0, 0.0)], 0.0
    for k in range(n - 1):
        a += rng.choice([0, 0, 90, -90]) if k % 5000 < 300 or 4090 < k % graph.BLOCK else 0  # long straight parts, and turns at borders of blocks
        xy.append((xy[-1][0] + math.cos(math.radians(a)), xy[-1][1] + math.sin(math.radians(a))))
    p = points(spark, [(i, *q) for i, q in enumerate(xy)])
    seg = spark.createDataFrame([(0, "s", i, i) for i in range(n)] + [(0, "t", i, i) for i in range(4)], "run_id long, seg string, pos long, id long")
    turns = [0.0] * n
    for k in range(1, n - 1):
        u, v = np.subtract(xy[k], xy[k - 1]), np.subtract(xy[k + 1], xy[k])
        turns[k] = math.acos(max(-1.0, min(1.0, float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)))))
    for gap in (2, 7, graph.BLOCK + 3):
        want = []
        for k in range(1, n - 1):
            if round(math.degrees(turns[k]), 6) >= 60 and (not want or k - want[-1] >= gap):
                want.append(k)
        got = graph.segment_turnings(p, seg, gap=gap).where("seg = 's'").collect()
        assert sorted((r.pos, r.id) for r in got) == [(k, k) for k in want] and len(want) > 2
    length = {r.seg: (r.nodes, r.length) for r in graph.segment_lengths(p, seg).collect()}
    assert length["s"] == (n, pytest.approx(n - 1)) and length["t"][0] == 4
    bend = {r.seg: r.total for r in graph.segment_curvature(p, seg).collect()}
    assert bend["s"] == pytest.approx(sum(turns))
    flags = [0, 1, graph.BLOCK - 1, graph.BLOCK, 2 * graph.BLOCK + 5, n - 1]
    pieces = graph.refined_segments(seg.where("seg = 's'"), spark.createDataFrame([(0, "s", k) for k in flags], "run_id long, seg string, pos long"))
    got = {r.piece: (r.lo, r.hi, r.n) for r in pieces.groupBy("piece").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).collect()}
    cuts = [0, *flags[1:-1], n - 1]
    assert got == {i: (lo, hi, hi - lo + 1) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]))}


def test_components_up_to_a_target(spark):
    p = points(spark, [(i, 0.0, 0.0) for i in (1, 2, 4, 9)])
    e, t = edges(spark, [(2, 4), (4, 9)]), spark.createDataFrame([(0, 6), (1, 70_000), (2, 0)], "run_id long, n_target int")
    got = {(r["run_id"], r["id"]): r["comp"] for r in graph.components(p, e, t).collect()}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, i): {4: 2, 9: 2}.get(i, i) for i in (1, 2, 3, 4, 5, 6, 9)}
    assert {k: v for k, v in got.items() if k[0]} == {(1, i): i for i in range(1, 70_001)}
