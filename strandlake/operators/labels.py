"""Labels and names of saved states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: texts in names and their labels (fixed values)
PATTERNS = [("hc5AF", "C5"), ("wt2_newsep", "C2"), ("hc15", "C15"), ("c4_7", "C4")]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def label(path: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """The label of the text that the name contains, else a C number between separators, else `Other`.

    Of several texts in one name, the first of the list counts.
    """
    name = base_name(path)
    out = None
    for text, is_ in PATTERNS if patterns is None else patterns:
        out = F.when(name.contains(text), is_) if out is None else out.when(name.contains(text), is_)
    found = F.regexp_extract(name, r"[_\.](C\d+)[_\.]", 1)
    rest = F.coalesce(F.nullif(found, F.lit("")), F.lit("Other"))
    return rest if out is None else out.otherwise(rest)


def labelled(files: DataFrame) -> DataFrame:
    return files.withColumn("label", label(F.col("file")))


def first_files(files: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` files of every label by name."""
    w = Window.partitionBy("label").orderBy("file")
    return labelled(files).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def with_keyword(files: DataFrame, keyword: str) -> DataFrame:
    """Files whose lower-cased base name contains the keyword."""
    return files.where(F.lower(base_name(F.col("file"))).contains(keyword.lower()))


def state_name(stem: Column, n: Column, seed: Column, stamp: Column) -> Column:
    """mono_{stem}_N{n}_seed{seed}_{yyyymmdd_HHMM}.bin; the stem loses folder and extension."""
    bare = F.regexp_replace(base_name(stem), r"\.[^.]*$", "")
    return F.concat(F.lit("mono_"), bare, F.lit("_N"), n.cast("string"), F.lit("_seed"), seed.cast("string"), F.lit("_"), F.date_format(stamp, "yyyyMMdd_HHmm"), F.lit(".bin"))


def short_stamp(moment: Column) -> Column:
    """First ten hex digits of the SHA-1 of a moment."""
    return F.substring(F.sha1(F.date_format(moment, "yyyy-MM-dd HH:mm:ss").cast("binary")), 1, 10)
