"""Raster operators over pixels (img, row, col, gray)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import iterate
from ..plans.kernels import groups

#: side of a tile in which pixels are labelled at once
TILE = 64
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def dark(pixels: DataFrame, below: int = 50) -> DataFrame:
    return pixels.where(F.col("gray") < below).select("img", "row", "col")


def dilated(on: DataFrame, size: DataFrame) -> DataFrame:
    """3 x 3 dilation within the image; size has (img, rows, cols)."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in AROUND]))
    d = on.withColumn("o", o).select("img", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    return d.join(size, "img").where("row >= 0 and col >= 0 and row < rows and col < cols").select("img", "row", "col").distinct()


def image_size(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def islands(on: DataFrame) -> DataFrame:
    """(img, row, col, island): 8-neighbour components of the pixels, named by their smallest pixel (row, col).

    Pixels are labelled within square tiles first, a tile being at most TILE x TILE pixels of one image. Only pixels at borders of
    tiles are joined with their neighbours, and only tiles' labels are merged over the whole image.
    """
    parts = int(on.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    img = on.schema["img"].dataType.simpleString()
    p = on.select("img", *[F.col(c).cast("long").alias(c) for c in ("row", "col")]).distinct()
    p = p.withColumns({"trow": F.floor(F.col("row") / TILE), "tcol": F.floor(F.col("col") / TILE)})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["img", "trow", "tcol"]):
            row, col = t["row"].to_numpy(), t["col"].to_numpy()
            least = tile_labels(row - row.min(), col - col.min())
            yield pa.RecordBatch.from_arrays([t["img"].combine_chunks(), pa.array(row), pa.array(col), pa.array(row[least]), pa.array(col[least])], names=["img", "row", "col", "lrow", "lcol"])

    tiled = p.repartition(parts, "img", "trow", "tcol").sortWithinPartitions("img", "trow", "tcol", "row", "col")
    tiled = iterate.cut(tiled.mapInArrow(label, f"img {img}, row long, col long, lrow long, lcol long"), "tiles")
    name = F.struct("img", F.col("lrow").alias("row"), F.col("lcol").alias("col"))
    at = lambda c: F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1)
    border = tiled.where(at("row") | at("col"))
    half = [(0, 1), (1, -1), (1, 0), (1, 1)]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in half]))
    near = border.select("img", "row", "col", name.alias("a"), o.alias("o")).select("img", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), "a")
    links = near.join(border.select("img", "row", "col", name.alias("b")), ["img", "row", "col"]).where("a <> b").select("a", "b").distinct()
    c = iterate.components(links, "islands")
    found = tiled.withColumn("id", name).join(c, "id", "left").withColumn("top", F.coalesce("component", "id"))
    return found.select("img", "row", "col", F.struct("top.row", "top.col").alias("island"))


def tile_labels(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For pixels of one tile in order, the index of the first pixel of each one's component."""
    place = np.full((TILE + 2, TILE + 2), -1)
    place[row + 1, col + 1] = np.arange(len(row))
    pairs = [(i, place[row + 1 + r, col + 1 + c]) for i in [np.arange(len(row))] for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = (np.concatenate(x) for x in zip(*[(i[j >= 0], j[j >= 0]) for i, j in pairs]))
    least = np.arange(len(row))
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def island_stats(pixels: DataFrame, below: int = 50) -> DataFrame:
    """Density of dark pixels, and number, largest and mean area of islands, by image; all are taken of the dilated image.
    Images without dark pixels have no islands, and null areas."""
    on = iterate.cut(dilated(dark(pixels, below), image_size(pixels)), "dilated")
    n = islands(on).groupBy("img", "island").agg(F.count("*").alias("area"))
    i = n.groupBy("img").agg(F.count("*").alias("islands"), F.max("area").alias("max_area"), F.avg("area").alias("mean_area"), F.sum("area").alias("pixels"))
    d = pixels.groupBy("img").agg(F.count("*").alias("all"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return d.join(i, "img", "left").select("img", F.round(none("pixels") / F.col("all"), 6).alias("density"), none("islands").alias("islands"), "max_area", F.round("mean_area", 6).alias("mean_area"))
