"""Column names, fixed-size sketches and id filters for the corpus operators; tables and groups come from plans."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.iterate import components, cut, drop, shared_dir
from ..plans.kernels import groups

__all__ = ["components", "cut", "drop", "fresh", "groups", "id_filter", "one_column", "partitions", "passing", "shared_dir", "sketch_sum", "small_batches"]


def fresh(columns: list[str], name: str) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame, least: int = 12) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: rows and bytes of an Arrow batch; whole texts are long, and every task holds a batch on either side
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows or about BATCH_BYTES bytes, so that workers need little
    memory for whole texts."""
    for kind, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.max{kind}PerBatch"
        now = str(spark.conf.get(name)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def one_column(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Only the named columns, so that extra or clashing columns do not matter; key is cast to long."""
    small_batches(df.sparkSession)
    return df.select(df[key].cast("long").alias(key), *[df[c] for c in columns])


def sketch_sum(rows: DataFrame, fold: Callable[[pa.RecordBatch, np.ndarray], None], size: int, parts: int = 64, kind: type = np.int32) -> np.ndarray:
    """Sums, over all partitions, of an array of fixed size that fold() updates from each batch; kind holds one task's part.

    Tasks send compressed pieces; each piece is summed as a stream in one of `parts` groups, and the driver
    receives `size` numbers whatever the input's size.
    """
    step = size // parts

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for b in batches:
            fold(b, total)
        for k in range(parts):
            piece = total[k * step : (k + 1) * step]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([zlib.compress(piece.astype(np.int64).tobytes(), 1)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(v), np.int64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})

    out = np.zeros(size, np.int64)
    sent = rows.mapInArrow(local, "k int, v binary").repartition(min(parts, partitions(rows)), "k").mapInArrow(merge, "k int, v binary")
    for k, v in sent.collect():
        out[k * step : (k + 1) * step] = np.frombuffer(zlib.decompress(v), np.int64)
    return out


FILTER_LOG2 = 23


def _place(ids: pa.Array) -> np.ndarray:
    x = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - FILTER_LOG2)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A broadcast filter of fixed size (one MB) over a column of ids; others pass it now and then, these always."""

    def fold(b: pa.RecordBatch, total: np.ndarray) -> None:
        total[_place(b.column(0))] = 1

    return ids.sparkSession.sparkContext.broadcast(np.packbits(sketch_sum(ids, fold, 1 << FILTER_LOG2, kind=np.uint8) > 0))


def passes(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Which ids pass a filter, given as unpacked bits."""
    return bits[_place(ids)] > 0


def passing(rows: DataFrame, key: str, sent, inside: bool = True) -> DataFrame:
    """The rows whose key passes the filter, or those for which it surely does not. Null keys do not pass."""
    k = rows.columns.index(key)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value)
        for b in batches:
            ids = b.column(k)
            yes = passes(bits, ids.fill_null(0)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(yes == inside))

    return rows.mapInArrow(test, rows.schema)
