"""Cut tables and iterative graph jobs: every round is a table in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where unset, a local one (local master) or one in the warehouse, which
    must not be a local folder then."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own:
        if re.match(r"local(\[|$)", spark.sparkContext.master):
            _own[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir")
            if not re.match(r"(?!file:)[a-zA-Z][\w+.-]*:", folder):
                raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
            _own[app] = f"{folder}/_shared"
    return _own[app]


def cut(df: DataFrame, name: str, seen: dict[str, Column] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: real statistics, and lost executors cost no recomputation
    beyond it. Aggregates named in seen are taken while the rows are written, and stand in the table's attribute seen."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    watch = Observation()
    rows = df.observe(watch, *[c.alias(n) for n, c in seen.items()]) if seen else df
    rows.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if seen:
        out.seen = watch.get
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): for every id in edges (a, b) the smallest id that its links reach.

    Rounds of a large star and a small star, one job each; their number grows with the logarithm of a component's size. It
    ends when a round leaves the links as they were: their count and the sum of their hashes, taken while they are written.
    """
    seen = {"n": F.count("*"), "hashes": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name, seen)
    while e.seen["n"]:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small, name, seen)
        drop(e)
        same, e = new.seen == e.seen, new
        if same:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def orbits(steps: DataFrame, name: str = "orbits", labels: tuple[str, str] = ("h", "nxt")) -> DataFrame:
    """(h, orbit) of a permutation (h, nxt): the smallest element of every cycle, or smallest label, by pointer doubling. labels names the columns
    that hold the labels of h and of nxt."""
    state = cut(steps.select("h", "nxt", F.least(*labels).alias("orbit")), name)
    while True:
        ahead = state.select(F.col("h").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("orbit").alias("orbit2"))
        new = cut(state.join(ahead, "nxt").select("h", F.col("nxt2").alias("nxt"), F.least("orbit", "orbit2").alias("orbit"), (F.col("orbit2") < F.col("orbit")).alias("changed")), name)
        moved = new.where("changed").limit(1).count()
        drop(state)
        state = new
        if not moved:
            return state.select("h", "orbit")


def along_pointers(pointers: DataFrame, starts: DataFrame, key: list[str], at: str, to: str, name: str = "pointers") -> DataFrame:
    """starts (key, at, others), and all that chains of pointers (key, at, to) lead to from there, with steps from the start.

    Pointers over 2^i steps are tables, found by doubling; a chain's members are found from its start by the sums of them.
    """
    jumps = [cut(pointers.select(*key, at, to), name, {"n": F.count("*")})]
    while jumps[-1].seen["n"]:
        last = jumps[-1]
        ahead = last.select(*key, F.col(at).alias(to), F.col(to).alias("_further"))
        jumps.append(cut(last.join(ahead, [*key, to]).select(*key, at, F.col("_further").alias(to)), name, {"n": F.count("*")}))
    found = starts.withColumn("steps", F.lit(0).cast("long"))
    for i in range(len(jumps) - 2, -1, -1):
        more = found.join(jumps[i], [*key, at]).withColumn("steps", F.col("steps") + (1 << i)).drop(at).withColumnRenamed(to, at)
        new = cut(found.unionByName(more), name)
        drop(found)
        found = new
    for t in jumps:
        drop(t)
    return found
