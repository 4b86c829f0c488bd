"""Groups of rows as streams: one group at a time from partitions sorted by its key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables, from batches sorted by the keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *np.flatnonzero(change).tolist(), n]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(c[n - 1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def per_group(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table], list[dict]], schema: str) -> DataFrame:
    """Applies kernel to every group; it returns rows as dictionaries. Many small groups share a task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = df.sparkSession.createDataFrame([], schema).schema
    names = empty.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(empty)
        rows: list[dict] = []
        for t in groups(batches, keys):
            rows += kernel(t)
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=target)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=target)

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
