"""Graphs of many small components: packs of whole components, all of which a kernel searches at once.

Rows of nodes and edges are dealt by component and sorted, and a task goes through them a pack at a time. A pack holds components of some
ROWS rows together, so every step of a search is one numpy step over all of them, and a component's work is not a job, nor a Python loop of its
own. Components over the limits of is_small() are for plans/tiled.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import iterate, tiled

#: rows (nodes and edges) of a pack, from which the next component begins another one
ROWS = 1 << 16
#: squared degrees a node, on average; discs in contact have at most 36
SQUARES = 64
KEY = ["run_id", "comp"]


def is_small(nodes: Column, squares: Column) -> Column:
    """Components that a pack may hold: an eighth of a tile's nodes, and turns in proportion to them."""
    return (nodes <= tiled.TILE // 8) & (squares <= SQUARES * nodes)


def parted(edges: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """comps of small components; comps and edges of the others, None where there are none."""
    n = edges.select("run_id", F.explode(F.array("u", "v")).alias("id")).groupBy("run_id", "id").agg(F.count("*").alias("n"))
    sizes = comps.join(n, ["run_id", "id"], "left").groupBy(*KEY).agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("squares"))
    large = iterate.cut(sizes.where(~is_small(F.col("nodes"), F.col("squares"))).select(*KEY), "large", {"n": F.count("*")})
    if not large.seen["n"]:
        return comps, None, None
    others = iterate.cut(comps.join(large, KEY, "left_semi"), "large")
    between = edges.select("run_id", "u", "v").join(others.select("run_id", F.col("id").alias("u")), ["run_id", "u"], "left_semi")
    return comps.join(large, KEY, "left_anti"), others, iterate.cut(between.select("run_id", "u", "v"), "large")


class Pack:
    """Components with their nodes (sorted by component and id, so a smaller place is a smaller id within one) and half-edges (by tail and head)."""

    def __init__(self, t: pa.Table):
        run, comp, kind, a, b, x, y = (t[c].to_numpy() for c in ("run_id", "comp", "kind", "a", "b", "x", "y"))
        change = np.concatenate(([True], (run[1:] != run[:-1]) | (comp[1:] != comp[:-1])))
        group, node = np.cumsum(change), kind == 0
        known, self.first, self.group = np.unique(group[node], return_index=True, return_inverse=True)
        self.run, self.comp = run[node][self.first], comp[node][self.first]
        self.ids, self.x, self.y, self.n = a[node], x[node], y[node], int(node.sum())
        names, rank = np.unique(self.ids, return_inverse=True)
        places = self.group * len(names) + rank

        def place(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            g, r = np.searchsorted(known, group[~node]), np.searchsorted(names, ids)
            there = (g < len(known)) & (r < len(names))
            g, r = np.where(there, g, 0), np.where(there, r, 0)
            at = np.searchsorted(places, g * len(names) + r)
            at = np.where(at < len(places), at, 0)
            return at, there & (known[g] == group[~node]) & (names[r] == ids) & (places[at] == g * len(names) + r)

        if self.n:
            (u, has_u), (v, has_v) = place(a[~node]), place(b[~node])
            fits = has_u & has_v & (u != v)
            pairs = np.unique(np.minimum(u, v)[fits] * self.n + np.maximum(u, v)[fits])
        else:
            pairs = np.zeros(0, np.int64)
        self.u, self.v = pairs // max(self.n, 1), pairs % max(self.n, 1)
        self.halves(np.ones(len(pairs), bool))

    def halves(self, kept: np.ndarray) -> None:
        src, dst = np.concatenate((self.u[kept], self.v[kept])), np.concatenate((self.v[kept], self.u[kept]))
        order = np.lexsort((dst, src))
        self.src, self.dst = src[order], dst[order]
        self.dx, self.dy = self.x[self.dst] - self.x[self.src], self.y[self.dst] - self.y[self.src]
        self.gap = np.hypot(self.dx, self.dy)
        self.begin = np.searchsorted(self.src, np.arange(self.n + 1))

    def only(self, kept: np.ndarray) -> Pack:
        """The same nodes with some of the edges (u, v)."""
        out = object.__new__(Pack)
        out.__dict__.update(self.__dict__)
        out.halves(kept)
        return out

    def core(self) -> np.ndarray:
        """Nodes of the 2-core."""
        degree = np.diff(self.begin)
        gone, now = np.zeros(self.n, bool), np.flatnonzero(degree <= 1)
        while len(now):
            gone[now] = True
            near = self.dst[ranges(self.begin[now], self.begin[now + 1])]
            np.subtract.at(degree, near, 1)
            near = np.unique(near)
            now = near[~gone[near] & (degree[near] <= 1)]
        return ~gone

    def largest_tree(self, digits: int = 9) -> np.ndarray:
        """Marks the edges (u, v) of the maximum spanning forest by length, to so many digits; ties by (u, v). Rounds merge all trees over their best edges."""
        w = np.round(np.hypot(self.x[self.u] - self.x[self.v], self.y[self.u] - self.y[self.v]), digits)
        order = np.lexsort((self.v, self.u, -w))
        u, v, tree = self.u[order], self.v[order], np.arange(self.n)
        taken, left = np.zeros(len(order), bool), np.arange(len(order))
        while True:
            left = left[tree[u[left]] != tree[v[left]]]
            if not len(left):
                out = np.zeros(len(order), bool)
                out[order[taken]] = True
                return out
            best = np.full(self.n, len(order))
            np.minimum.at(best, tree[u[left]], left)
            np.minimum.at(best, tree[v[left]], left)
            roots = np.flatnonzero(best < len(order))
            e = best[roots]
            taken[e] = True
            to = np.arange(self.n)
            to[roots] = tree[u[e]] + tree[v[e]] - roots
            both = to[to[roots]] == roots
            to[roots[both]] = np.minimum(roots[both], to[roots[both]])
            while not np.array_equal(further := to[to], to):
                to = further
            tree = to[tree]

    def top(self, value: np.ndarray, among: np.ndarray | None = None, digits: int | None = 9) -> np.ndarray:
        """The node of the largest value in each component, then of the smallest id, of those of `among` with a finite value; -1 where there is none."""
        value = value if digits is None else np.round(value, digits)
        at = np.flatnonzero(np.isfinite(value) if among is None else np.isfinite(value) & among)
        at = at[np.lexsort((at, -value[at], self.group[at]))]
        out = np.full(len(self.first), -1)
        groups, firsts = np.unique(self.group[at], return_index=True)
        out[groups] = at[firsts]
        return out

    def from_nodes(self, starts: np.ndarray, by_length: bool = False) -> list[np.ndarray]:
        """cost, steps and length of every node from the starts, at most one in each component (-1: none); inf where not reached."""
        size = np.maximum(self.gap, SHORTEST)
        at = starts[starts >= 0]
        return search(self.begin, self.dst, size if by_length else np.ones(len(size)), size, self.n, at, np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at)))

    def sweeps(self, by_length: bool = False, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """a, farthest from the smallest node (of among) in each component, b, farthest from a, and the labels of the search from a."""
        a = self.top(self.from_nodes(self.top(np.zeros(self.n), among), by_length)[0], among)
        labels = self.from_nodes(a, by_length)
        return a, self.top(labels[0], among), labels


#: least length of a step
SHORTEST = 1e-9


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end, one range after the other."""
    count = end - begin
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)


def search(begin, to, cost, length, n, at, d, steps, size) -> list[np.ndarray]:
    """Labels (cost, steps, length) from the starts `at` with what they have cost already."""
    labels = [np.full(n, np.inf), np.zeros(n), np.zeros(n)]
    for x, y in zip(labels, (d, steps, size)):
        x[at] = y
    todo = np.zeros(n, bool)
    todo[at] = True
    if n:
        tiled.relax(begin, to, cost, length, labels, todo)
    return labels


class Turns:
    """A pack's half-edges as states: the next step costs 1 or its length, and lam' (1 - cos turn), lam' = lam pi^2 / 2."""

    def __init__(self, pack: Pack, lam: float, by_length: bool):
        self.pack, p = pack, pack
        self.size = np.maximum(p.gap, SHORTEST)
        self.step = self.size if by_length else np.ones(len(self.size))
        self.to = ranges(p.begin[p.dst], p.begin[p.dst + 1])
        count = p.begin[p.dst + 1] - p.begin[p.dst]
        of = np.repeat(np.arange(len(p.dst)), count)
        self.begin = np.concatenate(([0], np.cumsum(count)))
        flat = p.gap[of] * p.gap[self.to]
        cosine = np.divide(p.dx[of] * p.dx[self.to] + p.dy[of] * p.dy[self.to], flat, out=np.ones(len(of)), where=flat > 0)
        self.cost = self.step[self.to] + 0.5 * np.pi**2 * lam * (1 - np.clip(cosine, -1.0, 1.0))
        self.length = self.size[self.to]
        self.tail = of

    def from_nodes(self, a: np.ndarray) -> list[np.ndarray]:
        """Labels of all half-edges from the nodes a; the first step has no turn."""
        out = ranges(self.pack.begin[a], self.pack.begin[a + 1])
        return search(self.begin, self.to, self.cost, self.length, len(self.step), out, self.step[out], np.ones(len(out)), self.size[out])

    def into(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-edges that lead to the nodes b, and the place of each in b."""
        where = np.full(self.pack.n, -1)
        where[b] = np.arange(len(b))
        at = np.flatnonzero(where[self.pack.dst] >= 0)
        return at, where[self.pack.dst[at]]

    def ways(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """cost, steps and length from each a to its b, one pair for a component at most; 0 where they are equal, nan where b is not reached."""
        out = [np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))]
        apart = np.flatnonzero(a != b)
        labels = self.from_nodes(a[apart])
        at, of = self.into(b[apart])
        at, of = at[np.isfinite(labels[0][at])], of[np.isfinite(labels[0][at])]
        cost, steps, length = (x[at] for x in labels)
        order = np.lexsort((cost, length, steps, np.round(cost, 9), of))
        pair, firsts = np.unique(of[order], return_index=True)
        for x, y in zip(out, (cost, steps, length)):
            x[apart] = np.nan
            x[apart[pair]] = y[order[firsts]]
        return out


def before(of: np.ndarray, to: np.ndarray, cost: np.ndarray, d: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The predecessor of every state on a cheapest way: that of the smallest tie among those whose cost and arc make up its own; -1 at starts."""
    with np.errstate(invalid="ignore"):
        fits = np.flatnonzero((d[of] < d[to]) & (np.abs(d[of] + cost - d[to]) <= 1e-9 * (1 + d[to] * 1e-3)))
    fits = fits[np.lexsort((of[fits], tie[of[fits]], to[fits]))]
    states, firsts = np.unique(to[fits], return_index=True)
    out = np.full(len(d), -1)
    out[states] = of[fits[firsts]]
    return out


def traced(up: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which end, state, place from the start) of all states on the ways back from the ends."""
    rows, which, now = [], np.arange(len(ends)), ends
    while len(now):
        rows.append((which, now))
        which, now = which[up[now] >= 0], up[now][up[now] >= 0]
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    which, states = (np.concatenate(x) for x in zip(*rows))
    back = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    last = np.zeros(len(ends), np.int64)
    np.maximum.at(last, which, back)
    return which, states, last[which] - back


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    """Whole components, some ROWS rows at a time, from batches sorted by component."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            run, comp = t["run_id"].to_numpy(), t["comp"].to_numpy()
            ends = np.flatnonzero((run[1:] != run[:-1]) | (comp[1:] != comp[:-1]))
            if len(ends):
                yield Pack(t.slice(0, int(ends[-1]) + 1))
                t = t.slice(int(ends[-1]) + 1)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield Pack(pa.Table.from_batches(held))


def solved(points: DataFrame, edges: DataFrame, comps: DataFrame, kernel: Callable[[Pack], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The kernel's columns for every pack of components; edges to unknown nodes, self-loops and repeated edges do not matter."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = comps.select("run_id", "id", "comp").join(points.select("run_id", "id", "x", "y"), ["run_id", "id"])
    rows = nodes.select(*KEY, F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "x", "y")
    ends = edges.select("run_id", "u", "v").join(comps.select("run_id", F.col("id").alias("u"), "comp"), ["run_id", "u"])
    rows = rows.unionByName(ends.select(*KEY, F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in packs(batches):
            yield pa.RecordBatch.from_pydict(kernel(p))

    return rows.repartition(parts, *KEY).sortWithinPartitions(*KEY, "kind", "a", "b").mapInArrow(run, schema)
