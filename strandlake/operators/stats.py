"""Distributions of grouped measurements (label, run, area) and (label, run, len)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 64


def _ranks(df: DataFrame, groups: list[str], value: str, tie: str, extra: str | None = None) -> DataFrame:
    """rank (from 1), n and, for `extra`, its running sum and total, over each group in order of value and tie.

    Groups may hold most of the rows: they are cut into SPREAD value ranges by approximate quantiles, ranked within
    these, and shifted by what the ranges before hold. A value that fills several ranges is cut by `tie` in the same way.
    """
    if not groups:
        df, groups = df.withColumn("_all", F.lit(0)), ["_all"]
    cuts = df.groupBy(*groups).agg(F.percentile_approx(value, [i / SPREAD for i in range(1, SPREAD)], 2000).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    d = df.join(cuts, groups).withColumn("_heavy", F.size(F.filter("_cuts", lambda c: c == F.col(value))) > 1).withColumn("_part", part).drop("_cuts")
    ties = d.where("_heavy").groupBy(*groups, value).agg(F.percentile_approx(tie, [i / SPREAD for i in range(1, SPREAD)], 2000).alias("_ties"))
    d = d.join(ties, [*groups, value], "left").withColumn("_sub", F.coalesce(F.size(F.filter("_ties", lambda c: c < F.col(tie))), F.lit(0)))
    d = d.withColumn("_part", F.col("_part") * (2 * SPREAD) + F.greatest("_sub", F.lit(0))).drop("_ties", "_heavy", "_sub")
    sums = [F.count("*").alias("_n")] + ([F.sum(extra).alias("_s")] if extra else [])
    w = Window.partitionBy(*groups)
    before = d.groupBy(*groups, "_part").agg(*sums)
    before = before.withColumn("n", F.sum("_n").over(w)).withColumn("_base", F.sum("_n").over(w.orderBy("_part")) - F.col("_n"))
    if extra:
        before = before.withColumn("total", F.sum("_s").over(w)).withColumn("_sum", F.sum("_s").over(w.orderBy("_part")) - F.col("_s"))
    d = d.join(before.drop("_n", "_s"), [*groups, "_part"])
    o = Window.partitionBy(*groups, "_part").orderBy(value, tie)
    d = d.withColumn("rank", F.row_number().over(o) + F.col("_base"))
    if extra:
        d = d.withColumn("running", F.sum(extra).over(o.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_sum"))
    return d.drop("_part", "_base", "_sum", "_all")


def count_cdf(areas: DataFrame, least: float = 0.0) -> DataFrame:
    """(label, id, area, cdf): i / n over ascending areas; ties keep their own ranks, smaller ids first."""
    return _ranks(areas.where(F.col("area") >= least), ["label"], "area", "id").select("label", "id", "area", (F.col("rank") / F.col("n")).alias("cdf"))


def area_cdf(areas: DataFrame, least: float = 0.0) -> DataFrame:
    """(label, id, area, share): area up to each row over the whole area."""
    return _ranks(areas.where(F.col("area") >= least), ["label"], "area", "id", "area").select("label", "id", "area", (F.col("running") / F.col("total")).alias("share"))


def ecdf_on_log_grid(areas: DataFrame, points: int = 500, complement: bool = False) -> DataFrame:
    """(label, run, g, x, f): share of areas up to x on a grid of equal log10 steps over all labels' range.

    Areas are counted by the first grid point at or above them, then summed up over the grid.
    """
    a = areas.where("area > 0")
    lo, hi = a.agg(F.log10(F.min("area")), F.log10(F.max("area"))).first()
    if lo is None:
        return a.select("label", "run", F.lit(0).alias("g"), F.lit(0.0).alias("x"), F.lit(0.0).alias("f")).limit(0)
    step = (hi - lo) / (points - 1) if hi > lo else 1.0
    g = F.least(F.greatest(F.ceil(F.round((F.log10("area") - F.lit(lo)) / F.lit(step), 9)), F.lit(0)), F.lit(points - 1)).cast("int")
    counts = a.groupBy("label", "run", g.alias("g")).agg(F.count("*").alias("k"))
    groups = a.groupBy("label", "run").agg(F.count("*").alias("n"))
    grid = groups.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    w = Window.partitionBy("label", "run").orderBy("g")
    f = F.sum(F.coalesce("k", F.lit(0))).over(w) / F.col("n")
    out = grid.join(counts, ["label", "run", "g"], "left").withColumn("f", 1 - f if complement else f)
    return out.select("label", "run", "g", F.pow(F.lit(10.0), F.lit(lo) + F.col("g") * F.lit(step)).alias("x"), "f")


def cdf_band(ecdf: DataFrame) -> DataFrame:
    """(label, g, mean_f, std_f) across runs; one run has no deviation."""
    return ecdf.groupBy("label", "g").agg(F.avg("f").alias("mean_f"), F.stddev_samp("f").alias("std_f"))


def quantiles(df: DataFrame, groups: list[str], value: str, tie: str, **shares: float) -> DataFrame:
    """Exact quantiles of each group, linear between the two nearest ranks, from the ranks of value ranges."""
    r = _ranks(df.select(*groups, value, tie).where(F.col(value).isNotNull()), groups, value, tie)
    apart = lambda p: F.abs(F.col("rank") - 1 - F.lit(p) * (F.col("n") - 1))
    return r.groupBy(*groups).agg(*[F.sum(F.when(apart(p) < 1, F.col(value) * (1 - apart(p)))).alias(name) for name, p in shares.items()])


def box_stats(areas: DataFrame, clip: float = 0.99, scale: float = 1e-6) -> DataFrame:
    """Quartiles and 5 / 95 % whiskers by label after clipping at a global quantile."""
    scaled = areas.select("label", "id", (F.col("area") * scale).alias("a"))
    c = scaled.crossJoin(F.broadcast(quantiles(scaled, [], "a", "id", top=clip))).select("label", "id", F.least("a", "top").alias("a"))
    return quantiles(c, ["label"], "a", "id", low=0.05, q1=0.25, median=0.5, q3=0.75, high=0.95)


def box_iqr(areas: DataFrame, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last values within reach x IQR, and how many lie beyond, by label."""
    q = quantiles(areas, ["label"], "area", "id", q1=0.25, median=0.5, q3=0.75)
    a = areas.join(q, "label").withColumn("iqr", F.col("q3") - F.col("q1"))
    inside = F.col("area").between(F.col("q1") - reach * F.col("iqr"), F.col("q3") + reach * F.col("iqr"))
    return a.groupBy("label", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("area"))).alias("low"), F.max(F.when(inside, F.col("area"))).alias("high"), F.count_if(~inside).alias("outliers"))


def histogram(values: DataFrame, value: str, bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n) in equal bins over the whole range; the upper end belongs to the last bin."""
    ends = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    v = values.crossJoin(F.broadcast(ends))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0).cast("int")
    return v.groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n"))


def integer_histogram(lengths: DataFrame, value: str = "len") -> DataFrame:
    """(label, len, n, density): one bin for every length."""
    n = lengths.groupBy("label", value).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def integer_cdf(lengths: DataFrame, value: str = "len", complement: bool = False) -> DataFrame:
    """(label, len, f) on every integer of all labels' range; complement gives 1 - f."""
    ends = lengths.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    n = lengths.groupBy("label", value).agg(F.count("*").alias("k"))
    grid = n.groupBy("label").agg(F.sum("k").alias("total")).crossJoin(F.broadcast(ends)).select("label", "total", F.explode(F.sequence("lo", "hi")).alias(value))
    f = F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("label").orderBy(value)) / F.col("total")
    return grid.join(n, ["label", value], "left").select("label", value, (1 - f if complement else f).alias("f"))


#: cells per bandwidth, moments kept of each, and bandwidths beyond which a kernel is taken as 0
CELLS, MOMENTS, REACH = 8, 10, 8.0


def kernel_density(values: DataFrame, value: str, bandwidth: float, points: int = 128, by: str = "label", pad: float = 0.0) -> DataFrame:
    """(label, g, x, density): Gaussian kernel sums on a grid over all values' range, `pad` wider at either end.

    Values are binned into cells of an eighth of a bandwidth, which keep sums of powers of the distances u from their
    middles. A cell's kernels at a distance t from its middle are exp(-t^2 / 2) times the sum of He_k(t) u^k / k!, and are
    taken as 0 beyond REACH bandwidths, so a cell meets only the grid points near it. With |u| <= 1/16 and ten powers a
    kernel is within 1e-13 of its value (its peak is 1). Null and NaN values count nowhere.
    """
    values = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    lo, hi = values.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if lo is None:
        return values.select(by, F.lit(0).alias("g"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    first, last = lo - pad, hi + pad
    step = (last - first) / (points - 1)
    scaled = values.select(by, ((F.col(value) - F.lit(lo)) / F.lit(bandwidth)).alias("v")).withColumn("cell", F.floor(F.col("v") * CELLS))
    u = F.col("v") - (F.col("cell") + 0.5) / CELLS
    power = [F.lit(1.0)]
    for k in range(1, MOMENTS):
        power.append(power[-1] * u / k)
    cells = scaled.groupBy(by, "cell").agg(F.count("*").alias("n"), *[F.sum(m).alias(f"m{k}") for k, m in enumerate(power)])
    middle = F.lit(lo) + (F.col("cell") + 0.5) / CELLS * F.lit(bandwidth)
    if step:
        at = lambda d: ((middle - F.lit(first) + F.lit(d * REACH * bandwidth)) / F.lit(step))
        begin, end = F.greatest(F.ceil(at(-1)), F.lit(0)).cast("int"), F.least(F.floor(at(1)), F.lit(points - 1)).cast("int")
    else:
        begin, end = F.lit(0), F.lit(points - 1)
    near = cells.withColumn("t", middle).where(begin <= end).withColumn("g", F.explode(F.sequence(begin, end)))
    near = near.withColumn("t", (F.lit(first) + F.col("g") * F.lit(step) - F.col("t")) / F.lit(bandwidth))
    terms = sum((F.col(f"m{k}") * _polynomial(_hermite(k), F.col("t")) for k in range(1, MOMENTS)), F.col("m0"))
    sums = near.groupBy(by, "g").agg(F.sum(F.exp(-0.5 * F.col("t") * F.col("t")) * terms).alias("s"))
    grid = cells.groupBy(by).agg(F.sum("n").alias("total")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    density = F.coalesce("s", F.lit(0.0)) / (F.col("total") * F.lit(bandwidth * math.sqrt(2 * math.pi)))
    both = grid.withColumnRenamed(by, "_by").join(sums, F.col("_by").eqNullSafe(F.col(by)) & (grid["g"] == sums["g"]), "left")
    return both.select(F.col("_by").alias(by), grid["g"], (F.lit(first) + grid["g"] * F.lit(step)).alias("x"), density.alias("density"))


def _hermite(k: int) -> list[int]:
    """Coefficients, from the constant on, of the k-th polynomial He with exp(tu - u^2 / 2) = sum of He_k(t) u^k / k!."""
    a, b = [1], [0, 1]
    for i in range(1, k + 1):
        a, b = b, [x - i * y for x, y in zip([0, *b], [*a, 0, 0])]
    return a


def _polynomial(coefficients: list[int], t: Column) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in coefficients[-2::-1]:
        out = out * t + F.lit(float(c)) if c else out * t
    return out


def length_density(lengths: DataFrame, nm_per_unit: float = 1.55, bandwidth: float = 1.5, points: int = 128) -> DataFrame:
    """(g, x, density) of lengths in nanometres, on a grid four bandwidths wider than their range, from 0 on."""
    nm = lengths.select(F.lit(0).alias("label"), (F.col("length") * nm_per_unit).alias("nm"))
    return kernel_density(nm, "nm", bandwidth, points, pad=4 * bandwidth).where("x >= 0").drop("label")


def reject_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("code").agg(F.count("*").alias("n"))
