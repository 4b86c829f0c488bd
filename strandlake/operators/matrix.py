"""Interaction matrices as long tables: downsampling, scaling, weights and bond counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

BIN = 5
CUTOFF = 0.0005
TAU_ROW, GAMMA_ROW = 0.05, 2.0
TAU_COL, GAMMA_COL = 0.03, 1.0


def downsampled(m: DataFrame, block: int = BIN) -> DataFrame:
    """(r, c, w) from 1: means of block x block cells of a sparse matrix (r0, c0, v) from 0; absent cells are 0."""
    return m.groupBy((F.floor(F.col("r0") / block) + 1).cast("int").alias("r"), (F.floor(F.col("c0") / block) + 1).cast("int").alias("c")).agg((F.sum("v") / (block * block)).alias("w"))


def normalized(w: DataFrame, cutoff: float = CUTOFF, size: int = 72) -> DataFrame:
    """Total mass 1, cells up to the cutoff set to 0, then scaled to [0, 1]; a constant matrix becomes 0.

    `size` x `size` cells at most: the matrix has a fixed bound, so its totals are a one-row aggregate.
    """
    mass = w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("total")))).select("r", "c", (F.col("w") / F.col("total")).alias("w"))
    cutoffs = mass.select("r", "c", F.when(F.col("w") <= cutoff, 0.0).otherwise(F.col("w")).alias("w"))
    ends = cutoffs.agg(F.max("w").alias("hi"), F.min("w").alias("lo0"), F.count("*").alias("cells"))
    lo = F.when(F.col("cells") < size * size, F.least(F.col("lo0"), F.lit(0.0))).otherwise(F.col("lo0"))
    return cutoffs.crossJoin(F.broadcast(ends.select("hi", lo.alias("lo")))).select("r", "c", F.when(F.col("hi") > F.col("lo"), (F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("w"))


def row_mass(w: DataFrame, tau: float = TAU_ROW, gamma: float = GAMMA_ROW) -> DataFrame:
    """(r, mass, sharp): row sums and their sharpened form."""
    return w.groupBy("r").agg(F.sum("w").alias("mass")).withColumn("sharp", F.pow(F.greatest(F.col("mass") - tau, F.lit(0.0)), F.lit(gamma)))


def column_weights(w: DataFrame, rows: list[int], tau: float = TAU_COL, gamma: float = GAMMA_COL, eps: float = 2.220446049250313e-16) -> DataFrame:
    """(c, weight) of a set of rows: sharpened cells summed by column, at least eps."""
    return w.where(F.col("r").isin(rows)).groupBy("c").agg(F.greatest(F.sum(F.pow(F.greatest(F.col("w") - tau, F.lit(0.0)), F.lit(gamma))), F.lit(eps)).alias("weight"))


def row_product(w: DataFrame, rows: list[int]) -> DataFrame:
    """(r, product) of all entries of each given row that the table holds."""
    return w.where(F.col("r").isin(rows)).groupBy("r").agg(F.product("w").alias("product"))


def bearing(dx: Column, dy: Column) -> Column:
    """World angle of a direction in degrees, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def angle_bin(a: Column) -> Column:
    """Bin 1-72 of an angle; 0 and 360 are both in bin 1."""
    return (F.floor(F.pmod(a, F.lit(360)) / BIN) + 1).cast("int")


def bond_counts(points: DataFrame, edges: DataFrame, col_shift: int = 0) -> DataFrame:
    """(run_id, r, c, k): bonds by the bin of the parent's relative angle and of the child's spin.

    The smaller id counts as parent. col_shift moves the child's bin, for comparison with counts kept while growing.
    """
    end = lambda s: points.select("run_id", F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x", "y", "rotation")])
    e = edges.select("run_id", "u", "v").join(end("u"), ["run_id", "u"]).join(end("v"), ["run_id", "v"])
    dx, dy = F.col("x_v") - F.col("x_u"), F.col("y_v") - F.col("y_u")
    r = angle_bin(F.pmod(F.rint(bearing(dx, dy)) - F.col("rotation_u"), F.lit(360.0)))
    back = F.rint(F.degrees(F.atan2(-dy, -dx)))
    c = F.floor(F.pmod(back - F.col("rotation_v"), F.lit(360.0)) / BIN) + 1
    c = (F.pmod(c - 1 + col_shift, F.lit(72)) + 1).cast("int")
    return e.groupBy("run_id", r.alias("r"), c.alias("c")).agg(F.count("*").alias("k"))


def compared(w: DataFrame, k: DataFrame) -> DataFrame:
    """(r, c, w, k) each divided by its own maximum; cells of either."""
    top = lambda d, v: d.crossJoin(F.broadcast(d.agg(F.max(v).alias("top")))).select("r", "c", (F.col(v) / F.col("top")).alias(v))
    return top(w, "w").join(top(k, "k"), ["r", "c"], "full").select("r", "c", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("k", F.lit(0.0)).alias("k"))


def relative_bins(points: DataFrame, step: int = BIN) -> DataFrame:
    """(run_id, id, angle, bin) of every candidate direction relative to the monomer's rotation."""
    p = points.select("run_id", "id", "rotation", F.explode(F.sequence(F.lit(0), F.lit(360 - step), F.lit(step))).alias("angle"))
    return p.select("run_id", "id", "angle", angle_bin(geometry.relative_angle(F.col("rotation"), F.col("angle"))).alias("bin"))


def candidates(points: DataFrame, mass: DataFrame, radius: float = 1.0, step: int = BIN, top: int | None = None) -> DataFrame:
    """(run_id, parent, seq, angle, r, p, x, y, rank): directions of positive sharpened mass and where they lead.

    Ranks go by mass, smaller angles first in a tie; `top` keeps the first ones. The masses of the 72 bins are literals
    and a parent's candidates one array, so nothing is shuffled.
    """
    held = {r[0]: r[1] for r in mass.select("r", F.round("sharp", 9)).where("r between 1 and 72").collect()}
    masses = F.array(*[F.lit(float(held.get(i, 0.0))) for i in range(1, 360 // BIN + 1)])

    def option(angle: Column) -> Column:
        r = angle_bin(geometry.relative_angle(F.col("rotation"), angle))
        return F.struct((-F.element_at(masses, r)).alias("minus"), angle.alias("angle"), r.alias("r"))

    options = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.lit(360 - step), F.lit(step)), option), lambda o: o["minus"] < 0))
    options = F.slice(options, 1, top) if top else options
    c = points.select("run_id", F.col("id").alias("parent"), "x", "y", F.posexplode(options).alias("at", "o"))
    rad = F.radians("o.angle")
    return c.select("run_id", "parent", (F.col("parent") * 1000 + F.col("o.angle")).alias("seq"), "o.angle", "o.r", (-F.col("o.minus")).alias("p"), (F.col("x") + 2 * radius * F.cos(rad)).alias("x"), (F.col("y") + 2 * radius * F.sin(rad)).alias("y"), (F.col("at") + 1).alias("rank"))


def top_candidates(points: DataFrame, mass: DataFrame, k: int = 40, radius: float = 1.0, step: int = BIN) -> DataFrame:
    """The k heaviest candidates of every parent, smaller angles first in a tie."""
    return candidates(points, mass, radius, step, k)


def merged_candidates(c: DataFrame, tolerance: float = 0.05, rule: str = "root", eps: float = 2.220446049250313e-16) -> DataFrame:
    """Candidates whose places round to one point become one: (run_id, kx, ky, rows, parent, p, n).

    rule: `root` keeps a single candidate's p and takes the root of the sum of several, `sum` adds them,
    `product` multiplies them.
    """
    key = lambda v: F.rint(F.col(v) / tolerance).cast("long")
    p = {"root": F.when(F.count("*") == 1, F.max("p")).otherwise(F.greatest(F.sqrt(F.sum("p")), F.lit(eps))), "sum": F.sum("p"), "product": F.product("p")}[rule]
    return c.groupBy("run_id", key("x").alias("kx"), key("y").alias("ky")).agg(F.sort_array(F.collect_set("r")).alias("rows"), F.min_by("parent", "seq").alias("parent"), p.alias("p"), F.count("*").alias("n"))
