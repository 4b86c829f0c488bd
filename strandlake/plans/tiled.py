"""Shortest paths over graphs of any size, a tile of neighbouring nodes at a time.

Nodes are laid out along a space-filling curve and cut into ranges of about TILE nodes. A node's number holds its tile and its place there. All
arcs that leave a tile's nodes are one packed row. A search keeps labels (cost, steps, length) by tile and slot; searches from several
sources run in several slots, and sources of different components share a slot. In every round the tiles that got messages relax
their own nodes until nothing changes, nearest buckets first, and send what improved over their borders to other tiles. So the rounds
follow the number of tiles on a path, not its steps; a task holds one tile's labels and arcs; and each round is a table
in the shared folder. Labels are written by the tiles that worked only, with the round's number, and put together now and then.

Costs must be positive. Results are exact shortest costs, up to EPSILON for each node on a path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import iterate
from .kernels import groups

#: nodes of a tile
TILE = 1 << 14
#: improvements up to this do not count
EPSILON = 1e-12
#: rounds after which labels are put together
MERGED = 16
#: tiles that are named in a filter; more are joined
LISTED = 1000
_PLACE = (1 << 33) - 1

_SCHEMA = "tile long, kind int, slot int, round int, p binary, q binary, r binary, s binary"
_NAMES = ["tile", "kind", "slot", "round", "p", "q", "r", "s"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _spread(c: Column) -> Column:
    """The 24 low bits with a gap after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def along_curve(points: DataFrame) -> DataFrame:
    """points with z, their place on a Z-order curve over all points' bounding box."""
    box = points.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    place = lambda c: F.when(F.lit((box[f"hi{c}"] or 0) > (box[f"lo{c}"] or 0)), F.floor((F.col(c) - F.lit(box[f"lo{c}"])) / F.lit((box[f"hi{c}"] or 0) - (box[f"lo{c}"] or 0) or 1.0) * F.lit(float((1 << 24) - 1)))).otherwise(0).cast("long")
    return points.withColumn("z", _spread(place("x")).bitwiseOR(F.shiftleft(_spread(place("y")), 1)))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the column sid: ranges of about TILE rows by the order are tiles; a sid holds the tile and the place there."""
    tiles = max(1, -(-df.count() // TILE))
    return iterate.cut(df.repartitionByRange(tiles, *order).sortWithinPartitions(*order).withColumn("sid", F.monotonically_increasing_id()), name)


def _row(tile: int, kind: int, slot: int, round_: int, *parts: np.ndarray) -> list:
    return [tile, kind, slot, round_, *(p.tobytes() for p in parts), *[None] * (4 - len(parts))]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def relax(begin: np.ndarray, to: np.ndarray, cost: np.ndarray, length: np.ndarray, labels: list[np.ndarray], todo: np.ndarray) -> np.ndarray:
    """Relaxes arcs between a tile's nodes (to < 0: elsewhere) from the nodes marked in todo; marks all nodes that improved, these included."""
    d, hops, size = labels
    improved = todo.copy()
    step = float(cost.mean()) if len(cost) and cost.min() < cost.max() else 0.0
    waits = np.flatnonzero(todo)
    while len(waits):
        near = d[waits] <= d[waits].min() + step
        at, waits = waits[near], waits[~near]
        todo[at] = False
        count = begin[at + 1] - begin[at]
        of = np.repeat(at, count)
        arc = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[at], count)
        arc, of = arc[to[arc] >= 0], of[to[arc] >= 0]
        t, new = to[arc], d[of] + cost[arc]
        better = new < d[t] - EPSILON
        arc, of, t, new = arc[better], of[better], t[better], new[better]
        if not len(t):
            continue
        order = np.lexsort((new, t))
        order = order[np.concatenate(([True], t[order][1:] != t[order][:-1]))]
        arc, of, t = arc[order], of[order], t[order]
        d[t], hops[t], size[t] = new[order], hops[of] + 1, size[of] + length[arc]
        improved[t] = True
        waits = np.concatenate((waits, t[~todo[t]]))
        todo[t] = True
    return improved


class Tiled:
    """A graph whose arcs (a, b, cost, length) are packed by tile; a and b are sids of one numbering."""

    def __init__(self, arcs: DataFrame, name: str = "arcs"):
        spark = arcs.sparkSession
        self.name = name
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in groups(batches, ["tile"]):
                a, b = t["a"].to_numpy(), t["b"].to_numpy()
                yield _batch([_row(t["tile"][0].as_py(), 0, 0, 0, (a & _PLACE).astype(np.int32), b, t["cost"].to_numpy(), t["length"].to_numpy())])

        rows = arcs.select(F.shiftright("a", 33).alias("tile"), "a", "b", F.col("cost").cast("double").alias("cost"), F.col("length").cast("double").alias("length"))
        self.arcs = iterate.cut(rows.repartition(self.parts, "tile").sortWithinPartitions("tile", "a", "b").mapInArrow(pack, _SCHEMA), name)

    def search(self, starts: DataFrame) -> DataFrame:
        """(slot, sid, cost, steps, length): labels of all nodes that the starts (slot, sid, cost, steps, length) reach."""

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in groups(batches, ["tile", "slot"]):
                yield _batch([_row(t["tile"][0].as_py(), 2, t["slot"][0].as_py(), 0, t["sid"].to_numpy() & _PLACE, *(t[c].to_numpy() for c in ("cost", "steps", "length")))])

        sent = starts.select(F.shiftright("sid", 33).alias("tile"), F.col("slot").cast("int").alias("slot"), "sid", *[F.col(c).cast("double").alias(c) for c in ("cost", "steps", "length")])
        told = sent.repartition(self.parts, "tile").sortWithinPartitions("tile", "slot").mapInArrow(first, _SCHEMA)
        # the tiles that messages go to, noted while they are written
        seen = {"tiles": F.collect_set(F.when(F.col("kind") == 2, F.col("tile")))}
        done: list[DataFrame] = []
        active: list[int] | None = None
        k = 0
        while active is None or active:
            held = self.arcs
            for x in done:
                held = held.unionByName(x.where("kind = 1"))
            if active is None or len(active) > LISTED:
                held = held.join(told.select("tile").distinct(), "tile", "left_semi")
            else:
                held = held.where(F.col("tile").isin(active))
            k += 1
            new = iterate.cut(held.unionByName(told).repartition(self.parts, "tile").sortWithinPartitions("tile", "kind", "slot", "round").mapInArrow(_rounds(k), _SCHEMA), self.name, seen)
            active = new.seen["tiles"]
            done.append(new)
            told = new.where("kind = 2")
            if len(done) >= MERGED and active:
                merged, told = iterate.cut(_latest(done), self.name), iterate.cut(told, self.name)
                for x in done:
                    iterate.drop(x)
                done = [merged]

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tile, slot, *parts in zip(*(b.column(c).to_pylist() for c in (0, 2, 4, 5, 6))):
                    d, steps, size = (np.frombuffer(x) for x in parts)
                    at = np.flatnonzero(np.isfinite(d))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), slot, np.int32)), pa.array(at + (tile << 33)), pa.array(d[at]), pa.array(steps[at]), pa.array(size[at])], names=["slot", "sid", "cost", "steps", "length"])

        out = iterate.cut(_latest(done).mapInArrow(unpack, "slot int, sid long, cost double, steps double, length double"), "labels")
        for x in done:
            iterate.drop(x)
        return out


def _latest(done: list[DataFrame]) -> DataFrame:
    rows = done[0].where("kind = 1")
    if len(done) == 1:
        return rows
    for x in done[1:]:
        rows = rows.unionByName(x.where("kind = 1"))
    last = rows.groupBy("tile", "slot").agg(F.max("round").alias("round"))
    return rows.join(last, ["tile", "slot", "round"]).select(_NAMES)


def _rounds(k: int):
    """The work of a round: rows of a tile come as arcs, labels (the last counts) and messages."""

    def work(tile: int, arcs: tuple | None, labels: dict[int, list[np.ndarray]], told: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        if arcs is None:
            src, dst, cost, length = (np.zeros(0, t) for t in (np.int32, np.int64, float, float))
        else:
            src, dst, cost, length = (np.frombuffer(x, t) for x, t in zip(arcs, (np.int32, np.int64, float, float)))
        mine = dst >> 33 == tile
        to = np.where(mine, dst & _PLACE, -1)
        n = max(int(src.max(initial=-1)), int(to.max(initial=-1)), *(int(m[0].max()) for ms in told.values() for m in ms), *(len(x[0]) - 1 for x in labels.values())) + 1
        begin = np.searchsorted(src, np.arange(n + 1))
        out: list[list] = []
        for slot, messages in told.items():
            old = labels.get(slot)
            now = [np.full(n, np.inf), np.zeros(n), np.zeros(n)]
            if old is not None:
                for x, y in zip(now, old):
                    x[: len(y)] = y
            todo = np.zeros(n, bool)
            at, d, steps, size = (np.concatenate(x) for x in zip(*messages))
            order = np.lexsort((d, at))
            order = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))]
            order = order[d[order] < now[0][at[order]] - EPSILON]
            for x, y in zip(now, (d, steps, size)):
                x[at[order]] = y[order]
            todo[at[order]] = True
            if not len(order):
                continue
            improved = relax(begin, to, cost, length, now, todo)
            out.append(_row(tile, 1, slot, k, *now))
            over = np.flatnonzero(~mine & improved[src])
            if len(over):
                s, t, new = src[over], dst[over], now[0][src[over]] + cost[over]
                order = np.lexsort((new, t))
                order = order[np.concatenate(([True], t[order][1:] != t[order][:-1]))]
                s, t, new, over = s[order], t[order], new[order], over[order]
                cuts = np.flatnonzero(np.concatenate(([True], t[1:] >> 33 != t[:-1] >> 33, [True])))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    some = slice(lo, hi)
                    out.append(_row(int(t[lo] >> 33), 2, slot, k, t[some] & _PLACE, new[some], now[1][s[some]] + 1, now[2][s[some]] + length[over[some]]))
        if out:
            yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arcs, labels, told = None, None, {}, {}
        for b in batches:
            for tile, kind, slot, _, *parts in zip(*(b.column(c).to_pylist() for c in range(8))):
                if tile != now:
                    if now is not None:
                        yield from work(now, arcs, labels, told)
                    now, arcs, labels, told = tile, None, {}, {}
                if kind == 0:
                    arcs = parts
                elif kind == 1:
                    labels[slot] = [np.frombuffer(x) for x in parts[:3]]
                else:
                    told.setdefault(slot, []).append((np.frombuffer(parts[0], np.int64), *(np.frombuffer(x) for x in parts[1:])))
        if now is not None:
            yield from work(now, arcs, labels, told)

    return run
