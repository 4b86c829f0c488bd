"""Readers and writers of assembly files."""

from __future__ import annotations

import struct
import warnings
import zlib
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.labels import labelled

AREA_SCHEMA = "Claudin string, Area double"
PLACEMENT_SCHEMA = "x double, y double, rotation int"


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, v): the white-space separated numbers of every text file in order, i from 0.

    Files are read by lines, so a large one is many tasks: a number's place is counted within its split, from where the
    splits before it end.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("parts"))
    lines = lines.withColumn("n", F.size("parts"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("file", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("file", "block", upto(Window.partitionBy("file").orderBy("block")).alias("base"))
    at = lines.withColumn("at", upto(Window.partitionBy("file", "block").orderBy("row"))).join(blocks, ["file", "block"])
    at = at.select("file", (F.col("at") + F.col("base")).alias("at"), F.posexplode("parts").alias("k", "v"))
    return at.select("file", (F.col("at") + F.col("k")).alias("i"), F.col("v").cast("double").alias("v"))


def read_matrix(spark: SparkSession, path: str, size: int = 360) -> DataFrame:
    """(file, r0, c0, v) from size x size numbers in column-major order, so a line of the file is a column."""
    n = _numbers(spark, path)
    counts = n.groupBy("file").count().select("file", F.assert_true(F.col("count") == size * size, F.concat(F.lit(f"expected {size * size} numbers, found "), F.col("count").cast("string"))).alias("ok"))
    return n.join(counts, "file").where("ok is null").select("file", (F.col("i") % size).cast("int").alias("r0"), F.expr(f"cast(i div {size} as int)").alias("c0"), "v")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, x, y) from a flat list x y x y ...; an odd number of values is an error."""
    n = _numbers(spark, path)
    odd = n.groupBy("file").count().select("file", F.assert_true(F.col("count") % 2 == 0, "odd number of coordinates").alias("ok"))
    pairs = n.join(odd, "file").where("ok is null").groupBy("file", F.expr("i div 2").alias("id"))
    return pairs.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).alias("y")).select("file", (F.col("id") + 1).alias("id"), "x", "y")


def read_states(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Saved tables of a folder with the file each row came from and its label; files that cannot be read are skipped,
    with a warning that names the first five."""
    there = lambda kind: spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("mergeSchema", "true").format(kind).load(path)
    name = F.col("_metadata.file_name").alias("file")
    out = there("parquet").select("*", name)
    lost = there("binaryFile").where("length > 0").select(name).join(out.select("file").distinct(), "file", "left_anti").orderBy("file")
    if some := [r["file"] for r in lost.limit(6).collect()]:
        warnings.warn(f"without rows or unreadable: {', '.join(some[:5])}{', ...' if len(some) > 5 else ''}", stacklevel=2)
    return labelled(out)


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AREA_SCHEMA).csv(path, header=True).select(F.col("Claudin").alias("label"), F.col("Area").alias("area"))


def decode_pgm(raw: bytes) -> np.ndarray:
    """Gray values of a binary PGM image of 8 bits."""
    head, at = [], 0
    while len(head) < 4:  # magic, width, height, maximum; comments run to the end of the line
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
        elif raw[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while not raw[end : end + 1].isspace():
                end += 1
            head.append(raw[at:end])
            at = end
    w, h = int(head[1]), int(head[2])
    return np.frombuffer(raw, np.uint8, w * h, at + 1).reshape(h, w)


def decode_png(raw: bytes) -> np.ndarray:
    """Gray values of a PNG image of 8 bits a channel without interlacing; colours by their luma, alpha is dropped."""
    at, body, head = 8, [], ()
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", raw, at + 8)
        elif kind == b"IDAT":
            body.append(raw[at + 8 : at + 8 + size])
        at += size + 12
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8-bit gray or colour PNG without interlacing")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out, before = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int64)
    for i, line in enumerate(lines):
        kind, x = int(line[0]), line[1:].astype(np.int64)
        if kind == 1:
            x = x.reshape(-1, channels).cumsum(0).ravel()
        elif kind == 2:
            x = x + before
        elif kind in (3, 4):
            for j in range(len(x)):
                a, c = (x[j - channels], before[j - channels]) if j >= channels else (0, 0)
                b = before[j]
                if kind == 3:
                    x[j] += (a + b) // 2
                else:  # the neighbour nearest to a + b - c
                    x[j] += min((a, b, c), key=lambda v: abs(int(a + b - c) - int(v)))
                x[j] &= 255
        before = x & 255
        out[i] = before
    out = out.reshape(h, w, channels)
    return out[:, :, 0] if channels < 3 else np.round(out[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def read_rasters(spark: SparkSession, path: str, glob: str = "*.{pgm,png}") -> DataFrame:
    """(img, row, col, gray) of PGM and PNG images of 8 bits, one row of the scan an image."""
    import pandas as pd

    def decode(batches):
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                a = decode_png(raw) if raw[:4] == b"\x89PNG" else decode_pgm(raw)
                r, c = np.indices(a.shape)
                yield pd.DataFrame({"img": name, "row": r.ravel(), "col": c.ravel(), "gray": a.ravel().astype(int)})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(decode, "img string, row long, col long, gray int")


def write_placements(points: DataFrame, path: str) -> None:
    points.select("x", "y", "rotation").write.mode("overwrite").csv(path, header=True)


def write_areas(areas: DataFrame, path: str) -> None:
    areas.select(F.col("label").alias("Claudin"), F.col("area").alias("Area")).write.mode("overwrite").csv(path, header=True)


def write_state(tables: dict[str, DataFrame], path: str) -> None:
    """A state's tables as Parquet, each partitioned by run."""
    for name, t in tables.items():
        t.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/{name}")


def write_checkpoint(tables: dict[str, DataFrame], folder: str, stem: str, placed: int, tag: str, moment: datetime) -> str:
    """A state's tables under {folder}/{stem}_{stamp}_{placed}_{tag}; tags are auto, plateau and final. Returns the path."""
    if tag not in ("auto", "plateau", "final"):
        raise ValueError(f"tag: {tag}")
    path = f"{folder}/{stem}_{moment:%Y%m%d_%H%M%S}_{placed}_{tag}"
    write_state(tables, path)
    return path
