"""Growth of assemblies: one sequential kernel per run, runs in parallel.

Discs are placed one at a time. The newest monomers with free neighbour places propose positions at 72 directions,
weighted by the sharpened row mass of the interaction matrix; positions that round to one point are merged; one is
drawn by weight. A full box, a missing or saturated contact, an overlap or too many contacts reject it. The child's spin
is drawn by the column weights of the supporting rows. After many failures in a row a strand is seeded away from the
assembly. Same seed, same result; results differ from run to run only by seed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.kernels import per_group
from . import matrix as mx

#: rejection codes (fixed values)
NO_CANDIDATE, BOX_FULL, TOO_MANY, COLLISION, NO_CONTACT = -1, -2, -3, -4, -6


@dataclass(frozen=True)
class Config:
    radius: float = 1.0
    box: int = 10
    box_capacity: int = 10
    neighbours: int = 3
    grid: int = 2000
    frontier: int = 40
    top_k: int = 40
    tolerance: float = 0.05
    soft_stall: int = 200
    hard_stall: int = 800
    most_seeds: int = 5
    strand: int = 6


class Proposals:
    """What a matrix says, for all runs of a worker: weights by row, cells by spin, and what a monomer of each rotation proposes."""

    def __init__(self, weights: np.ndarray, config: Config):
        self.c = config
        self.sharp = np.maximum(weights.sum(1) - mx.TAU_ROW, 0.0) ** mx.GAMMA_ROW
        self.cells = np.maximum(weights - mx.TAU_COL, 0.0) ** mx.GAMMA_COL
        self._by_rotation: dict[int, tuple[np.ndarray, ...]] = {}

    def of(self, rotation: int) -> tuple[np.ndarray, ...]:
        """Steps in x and y, rows and weights of the directions of positive weight, heaviest first."""
        found = self._by_rotation.get(rotation)
        if found is None:
            angles = np.arange(0, 360, mx.BIN)
            rows = (angles - rotation) % 360 // mx.BIN
            p = self.sharp[rows]
            order = np.lexsort((angles, -p))[: self.c.top_k]
            order = order[p[order] > 0]
            rad = np.radians(angles[order])
            found = self._by_rotation[rotation] = (2 * self.c.radius * np.cos(rad), 2 * self.c.radius * np.sin(rad), rows[order], p[order])
        return found


@dataclass
class Candidates:
    """Merged positions in the order of their first proposals, in steps of the tolerance; of: the place of each proposal. They hold until the
    assembly changes, and so do the codes of those that were drawn."""

    kx: np.ndarray
    ky: np.ndarray
    weight: np.ndarray
    parent: np.ndarray
    of: np.ndarray
    rows: np.ndarray
    codes: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.share = shares(self.weight) if len(self.weight) else self.weight


def shares(weight: np.ndarray) -> np.ndarray:
    """Running shares of weights, by which a random number draws one."""
    run = (weight / weight.sum()).cumsum()
    return run / run[-1]


class Assembly:
    """State of one run. What the newest monomers propose is merged again only after a change; a rejected position changes nothing."""

    def __init__(self, weights: np.ndarray, config: Config, seed: int, proposals: Proposals | None = None):
        self.c = config
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.proposals = Proposals(weights, config) if proposals is None else proposals
        start = 5.0 * config.grid
        self.x, self.y, self.rotation, self.near, self.degree = [start], [start], [18], [0], [0]
        self.edges: list[tuple[int, int]] = []
        self.boxes: dict[tuple[int, int], list[int]] = {self.box_of(start, start): [0]}
        self.rejected: dict[int, int] = {}
        self._offers: dict[int, tuple[np.ndarray, ...]] = {}
        self._held: dict[int, Candidates] = {}
        reach = 2 * config.radius * mx_contact()
        self.lo2, self.hi2 = (reach * 0.98) ** 2, reach**2

    def box_of(self, x: float, y: float) -> tuple[int, int]:
        return int(x // self.c.box), int(y // self.c.box)

    def around(self, x: float, y: float) -> list[tuple[int, float]]:
        """Monomers of the boxes around a place, and their squared distances."""
        bx, by = self.box_of(x, y)
        return [(i, (self.x[i] - x) * (self.x[i] - x) + (self.y[i] - y) * (self.y[i] - y)) for a in (-1, 0, 1) for b in (-1, 0, 1) for i in self.boxes.get((bx + a, by + b), ())]

    def _offer(self, i: int) -> tuple[np.ndarray, ...]:
        found = self._offers.get(i)
        if found is None:
            dx, dy, rows, p = self.proposals.of(self.rotation[i])
            kx = np.rint((self.x[i] + dx) / self.c.tolerance).astype(int)
            ky = np.rint((self.y[i] + dy) / self.c.tolerance).astype(int)
            found = self._offers[i] = kx, ky, rows, p, np.full(len(p), i)
        return found

    def candidates(self, first: int) -> Candidates:
        """Merged positions of the newest monomers from `first` on that have free neighbour places."""
        if first in self._held:
            return self._held[first]
        offers = [self._offer(i) for i in range(max(first, len(self.x) - self.c.frontier), len(self.x)) if self.near[i] < self.c.neighbours]
        kx, ky, rows, p, parent = (np.concatenate(v) for v in zip(*offers)) if offers else (np.zeros(0, t) for t in (int, int, int, float, int))
        _, at, of = np.unique(kx * (1 << 32) + ky, return_index=True, return_inverse=True)
        order = np.argsort(at)
        place = np.empty(len(at), int)
        place[order] = np.arange(len(at))
        of, at = place[of], at[order]
        several = np.maximum(np.sqrt(np.bincount(of, p, len(at))), 2.220446049250313e-16)
        weight = np.where(np.bincount(of, minlength=len(at)) == 1, p[at], several)
        found = self._held[first] = Candidates(kx[at], ky[at], weight, parent[at], of, rows)
        return found

    def _code(self, x: float, y: float, parent: int) -> int:
        """Why a monomer can't be placed there, or 0."""
        if len(self.boxes.get(self.box_of(x, y), ())) >= self.c.box_capacity:
            return BOX_FULL
        around = self.around(x, y)
        touch = [i for i, d2 in around if d2 <= self.hi2]
        if any(d2 < self.lo2 for _, d2 in around) or any(self.near[i] >= self.c.neighbours for i in touch):
            return COLLISION
        if len({*touch, parent}) > self.c.neighbours:
            return TOO_MANY
        return 0 if touch else NO_CONTACT

    def add(self, first: int = 0) -> int:
        """Tries to place one monomer next to those from `first` on; its index, or a rejection code."""
        found = self.candidates(first)
        if not len(found.weight):
            return NO_CANDIDATE
        k = int(found.share.searchsorted(self.rng.random(), side="right"))
        x, y, parent = int(found.kx[k]) * self.c.tolerance, int(found.ky[k]) * self.c.tolerance, int(found.parent[k])
        code = found.codes.get(k)
        if code is None:
            code = found.codes[k] = self._code(x, y, parent)
        if code == BOX_FULL:
            return code
        drawn = self.rng.random()  # for the spin
        if code < 0:
            return code
        column = np.maximum(self.proposals.cells[np.unique(found.rows[found.of == k])].sum(0), 2.220446049250313e-16)
        spin = int(shares(column).searchsorted(drawn, side="right")) + 1
        contacts = sorted({*(i for i, d2 in self.around(x, y) if d2 <= self.hi2), parent})
        back = round(math.degrees(math.atan2(self.y[parent] - y, self.x[parent] - x)))
        new = self._put(x, y, (back - mx.BIN * spin) % 360)
        for i in contacts:
            self.edges.append((i, new))
            for j in (i, new):
                self.near[j] += 1
                self.degree[j] += 1
        return new

    def _put(self, x: float, y: float, rotation: int) -> int:
        new = len(self.x)
        self._held.clear()
        for values, v in ((self.x, x), (self.y, y), (self.rotation, rotation), (self.near, 0), (self.degree, 0)):
            values.append(v)
        self.boxes.setdefault(self.box_of(x, y), []).append(new)
        return new

    def far_seed(self, near: float = 10.0, far: float = 30.0) -> int:
        """A monomer without bonds at a random side of the bounding box, clear of all others; -1 if there is no room."""
        side, along, away = int(self.rng.integers(4)), float(self.rng.random()), float(self.rng.uniform(near, far))
        x0, x1, y0, y1 = min(self.x), max(self.x), min(self.y), max(self.y)
        x, y = ((x0 - away, y0 + along * (y1 - y0)), (x1 + away, y0 + along * (y1 - y0)), (x0 + along * (x1 - x0), y0 - away), (x0 + along * (x1 - x0), y1 + away))[side]
        clear = all(d2 >= self.lo2 for _, d2 in self.around(x, y))
        if not clear or len(self.boxes.get(self.box_of(x, y), ())) >= self.c.box_capacity:
            return -1
        return self._put(x, y, 0)

    def drop_from(self, first: int) -> None:
        """Takes back the newest monomers; neighbours get their places back."""
        for i, j in self.edges:
            if j >= first > i:
                self.near[i] -= 1
                self.degree[i] -= 1
        self.edges = [e for e in self.edges if e[1] < first]
        self._held.clear()
        for i in range(first, len(self.x)):
            self._offers.pop(i, None)
            self.boxes[self.box_of(self.x[i], self.y[i])].remove(i)
        for values in (self.x, self.y, self.rotation, self.near, self.degree):
            del values[first:]

    def seed_strand(self) -> bool:
        """A far seed that must grow to `strand` monomers, or is taken back."""
        first = self.far_seed()
        if first < 0:
            return False
        for _ in range(20 * self.c.strand):
            if len(self.x) - first >= self.c.strand:
                return True
            self._try(first)
        if len(self.x) - first < self.c.strand:
            self.drop_from(first)
            return False
        return True

    def _try(self, first: int = 0) -> bool:
        code = self.add(first)
        if code < 0:
            self.rejected[code] = self.rejected.get(code, 0) + 1
        return code >= 0

    def grow(self, target: int) -> None:
        failed = seeded = 0
        while len(self.x) < target and failed < self.c.hard_stall:
            if self._try():
                failed = 0
                continue
            failed += 1
            if failed % self.c.soft_stall == 0 and seeded < self.c.most_seeds:
                seeded += 1
                if self.seed_strand():
                    failed = 0


def mx_contact() -> float:
    from .spatial import CONTACT_SCALE

    return CONTACT_SCALE


SCHEMA = "run_id long, kind string, id long, x double, y double, rotation int, degree long, u long, v long, code long, n long"


def grow(runs: DataFrame, weights: np.ndarray, config: Config = Config()) -> DataFrame:
    """Grows every run (run_id, seed, n_target) in a task of its own group: rows of kind monomer, edge or rejected.

    weights is the scaled 72 x 72 matrix; ids count from 1. Use monomers(), bonds() and rejections() on the result.
    """
    sent = runs.sparkSession.sparkContext.broadcast(np.asarray(weights, float))
    shared: dict[str, Proposals] = {}  # a worker's own
    blank = dict.fromkeys(("id", "x", "y", "rotation", "degree", "u", "v", "code", "n"))

    def kernel(t: pa.Table) -> list[dict]:
        out = []
        for run, seed, target in zip(*(t[c].to_pylist() for c in ("run_id", "seed", "n_target"))):
            if not shared:
                shared["all"] = Proposals(sent.value, config)
            a = Assembly(sent.value, config, seed, shared["all"])
            a.grow(target)
            head = blank | {"run_id": run}
            out += [head | {"kind": "monomer", "id": i + 1, "x": a.x[i], "y": a.y[i], "rotation": a.rotation[i], "degree": a.degree[i]} for i in range(len(a.x))]
            out += [head | {"kind": "edge", "u": u + 1, "v": v + 1} for u, v in a.edges]
            out += [head | {"kind": "rejected", "code": k, "n": n} for k, n in sorted(a.rejected.items())]
        return out

    return per_group(runs.select("run_id", "seed", "n_target"), ["run_id"], ["seed"], kernel, SCHEMA)


def monomers(grown: DataFrame) -> DataFrame:
    return grown.where("kind = 'monomer'").select("run_id", "id", "x", "y", "rotation", "degree")


def bonds(grown: DataFrame) -> DataFrame:
    return grown.where("kind = 'edge'").select("run_id", "u", "v")


def rejections(grown: DataFrame) -> DataFrame:
    return grown.where("kind = 'rejected'").select("run_id", "code", "n")


def weights_array(w: DataFrame) -> np.ndarray:
    """The 72 x 72 matrix of a long table (r, c, w); its size is fixed."""
    out = np.zeros((72, 72))
    for r, c, v in w.where("r between 1 and 72 and c between 1 and 72").select("r", "c", F.col("w")).collect():
        out[r - 1, c - 1] = v
    return out
