"""Assemblies and measurements derived from the relational tables, as normalized tables.

Every table is read whole. The lattice (and the raster of its occupancy) places one disc for each order whose residue
says that its place is occupied, about 40 of 100: that is the definition of the fixture in FIXTURES.md, which the SQL of
all lattice queries states too, not a sample of a larger input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import contact_edges

WIDTH = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monomers (run_id, id, x, y, rotation): discs of radius 1 on a triangular lattice, of whose places (one for each
    order) the fixture's rule leaves about 40 % occupied."""
    k = F.col("o_orderkey")
    row = F.expr(f"o_orderkey div {WIDTH}")
    chosen = table(spark, sf_dir, "orders").where("(o_custkey * 7919 + o_orderkey * 104729) % 100 < 40")
    return chosen.select(
        F.lit(0).cast("long").alias("run_id"), k.alias("id"),
        (2.0 * ((k % WIDTH) + 0.5 * (row % 2))).alias("x"), (F.sqrt(F.lit(3.0)) * row).alias("y"),
        ((F.col("o_custkey") * 5) % 360).cast("int").alias("rotation"),
    )


def strips(points: DataFrame) -> DataFrame:
    """The same monomers as many runs: one for every ten lattice rows."""
    return points.withColumn("run_id", F.expr(f"id div {10 * WIDTH}"))


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_edges(lattice(spark, sf_dir), radius=1.0)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free points (id, x, y, grp) from the first two coordinates of the embeddings."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) >= 2")
    at = lambda i: F.col("embedding")[i].cast("double") * 100
    return e.select(F.lit(0).cast("long").alias("run_id"), F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), (F.col("label") % 4).alias("grp"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse 360 x 360 interaction matrix (r0, c0, v), from 0."""
    li = table(spark, sf_dir, "lineitem")
    r0 = F.col("l_partkey") % 360
    c0 = (r0 + F.col("l_linenumber") * 15 + F.col("l_suppkey") % 15) % 360
    return li.groupBy(r0.alias("r0"), c0.alias("c0")).agg(F.sum("l_quantity").alias("v"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped measurements (id, label, run, area)."""
    label = F.expr("case o_custkey % 4 when 0 then 'C2' when 1 then 'C4' when 2 then 'C5' else 'C15' end")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), label.alias("label"), (F.col("o_orderkey") % 5).alias("run"), F.col("o_totalprice").alias("area"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of saved states (id, file)."""
    stem = "case o_custkey % 5 when 0 then 'hc5AF' when 1 then 'wt2_newsep' when 2 then 'hc15' when 3 then 'c4_7' else 'x_C9_y' end"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"concat('mono_', {stem}, '_N', cast(o_orderkey as string), '.bin') as file", "o_custkey as seed")


def placement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome codes of placements (event_id, ts, code)."""
    code = "case event_type when 'error' then -4 when 'click' then -2 when 'view' then -6 when 'signup' then -3 else 1 end"
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", f"{code} as code")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster (img, row, col, gray) of the lattice's occupancy: dark where occupied."""
    dark = "(o_custkey * 7919 + o_orderkey * 104729) % 100 < 40"
    return table(spark, sf_dir, "orders").selectExpr("0L as img", f"o_orderkey div {WIDTH} as row", f"o_orderkey % {WIDTH} as col", f"case when {dark} then 20 else 200 end as gray")
