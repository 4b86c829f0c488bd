"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

Rows are compared only within one label and dimension. Equal vectors form a class first. A vector's hash in a table
joins `FUNCTIONS` cross-polytope functions: three rounds of random signs and the Walsh-Hadamard transform, then the
largest coordinate with its sign. Multiprobe adds the buckets with a runner-up coordinate. Vectors that share any
bucket are candidates. First only ids and signatures of 128 sign bits are dealt to buckets: a vector of whose bucket no
other one differs in few enough bits (six deviations over the mean at the limit) needs no verification there. The
vectors of the others follow, and all their pairs are verified by cosine in double precision. Buckets are processed in
blocks of two chunks of at most CHUNK vectors, so a bucket of any size is compared in full by tasks of bounded memory. A
pair that shares several buckets counts in the first. Vectors of single precision are sent as such.

Null label or vec_id, null, empty or zero vectors and those with null or non-finite components link with nothing and
are kept. Rows that share a vec_id are one vector for components and add up their links. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TABLES = 6
FUNCTIONS = 2
CHUNK = 512
SEED = 977
BITS = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def buckets(vectors: np.ndarray) -> np.ndarray:
    """Keys of every vector: (vectors, TABLES, probes)."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = vectors
    rng = np.random.Generator(np.random.PCG64(SEED))
    rows = np.arange(n)
    out = np.zeros((n, TABLES, FUNCTIONS + 2), np.int64)
    for t in range(TABLES):
        first, second = [], []
        for _ in range(FUNCTIONS):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), size))
            a = np.abs(y)
            top = a.argmax(1)
            a[rows, top] = -1
            for at, keep in ((top, first), (a.argmax(1), second)):
                keep.append(2 * at + (y[rows, at] < 0))
        # the bucket of all best coordinates, and those with one runner-up; one of both runners-up
        choices = [first, *([*first[:f], second[f], *first[f + 1 :]] for f in range(FUNCTIONS)), second]
        for p, choice in enumerate(choices):
            key = np.zeros(n, np.int64)
            for c in choice:
                key = key * (2 * size) + c
            out[:, t, p] = key
    return out


def signatures(vectors: np.ndarray) -> np.ndarray:
    """BITS signs of rotated coordinates as (vectors, BITS / 64) numbers; zeros in few dimensions, where signs depend on each other."""
    n, d = vectors.shape
    size = 1 << max(1, (d - 1).bit_length())
    if size < 32:
        return np.zeros((n, BITS // 64), np.int64)
    x = np.zeros((n, size))
    x[:, :d] = vectors
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    signs: list[np.ndarray] = []
    while sum(s.shape[1] for s in signs) < BITS:
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice((-1.0, 1.0), size))
        signs.append(y > 0)
    return np.packbits(np.concatenate(signs, 1)[:, :BITS], axis=1).view(np.int64)


def most_bits(least: float) -> int:
    """Bits in which two vectors with this cosine may differ."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(BITS * p + 6 * math.sqrt(BITS * p * (1 - p)))


def encoded(x: np.ndarray) -> bytes:
    """A vector in single precision if that is exact, else in double precision and one byte more."""
    small = x.astype(np.float32)
    return small.tobytes() if (small.astype(np.float64) == x).all() else x.tobytes() + b"d"


def dimensions(raw: bytes) -> int:
    return len(raw) // 8 if len(raw) % 4 else len(raw) // 4


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Rows as doubles; None for those that link with nothing."""
    out = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            x = np.array(v, np.float64)
            if not np.isfinite(x).all() or not x.any():
                x = None
        out.append(x)
    return out


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(r[:-1]) if len(r) % 4 else np.frombuffer(r, np.float32).astype(np.float64) for r in raw])
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def whole_blocks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by key as tables of whole blocks, with the first row of each; a block may span batches."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        change = np.zeros(t.num_rows, bool)
        for c in key:
            v = t[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        begins = np.concatenate(([0], np.flatnonzero(change)))
        last = int(begins[-1])  # this block may go on in the next batch
        if last:
            yield t.slice(0, last), begins[:-1]
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def pairs_of(begins: np.ndarray, n: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one block, some `most` at a time (a row's pairs stay together)."""
    left = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n))) - np.arange(n) - 1
    upto = np.cumsum(left)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        count = left[lo:hi]
        a = np.repeat(np.arange(lo, hi), count)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        lo = hi


def near_vectors(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept."""
    e = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].cast("string").alias("label"), embeddings["embedding"].cast("array<double>").alias("embedding"))
    parts = common.partitions(e)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if v is None else encoded(v) for v in _vectors(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    rows = common.cut(e.mapInArrow(read, "vec_id long, label string, raw binary"), "vectors")
    classes = common.cut(rows.where("raw is not null and label is not null and vec_id is not null").groupBy("label", "raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, label, raw = b.column(0).to_numpy(), b.column(2), b.column(1).to_pylist()
            size = np.array([dimensions(r) for r in raw])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                x = _units([raw[i] for i in at])
                keys, signs = buckets(x), signatures(x)
                n, t, p = keys.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], t * p)), label.take(pa.array(np.repeat(at, t * p))), pa.array(np.full(n * t * p, s, np.int32)), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(keys.ravel()), *(pa.array(np.repeat(signs[:, k], t * p)) for k in range(2))],
                    names=["id", "label", "size", "t", "bucket", "s0", "s1"],
                )

    key = ["space", "t", "bucket"]
    space = F.xxhash64("label", "size").alias("space")
    dealt = common.cut(classes.select("id", "raw", "label").mapInArrow(deal, "id long, label string, size int, t int, bucket long, s0 long, s1 long").select("id", space, "t", "bucket", "s0", "s1").distinct(), "buckets")
    full = dealt.groupBy(*key).count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / F.lit(CHUNK)).cast("int")).drop("count")
    m = dealt.join(common.cut(full, "full"), key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select(*key, "id", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "s0", "s1")
    key += ["i", "j"]
    limit = most_bits(least)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose block has another vector that differs in few bits."""
        for t, begins in whole_blocks(batches, key):
            s, part = np.stack((t["s0"].to_numpy(), t["s1"].to_numpy()), 1).view(np.uint64), t["part"].to_numpy()
            cross, keep = t["i"].to_numpy() != t["j"].to_numpy(), np.zeros(len(part), bool)
            for a, b in pairs_of(begins, len(part)):
                near = (np.bitwise_count(s[a] ^ s[b]).sum(1, dtype=np.int16) <= limit) & (~cross[a] | (part[a] != part[b]))
                keep[a[near]] = keep[b[near]] = True
            yield from t.filter(pa.array(keep)).select([*key, "id", "part"]).combine_chunks().to_batches()

    m = m.repartition(parts, *key).sortWithinPartitions(*key)
    m = common.cut(m.select(*key, "id", "part", "s0", "s1").mapInArrow(alike, "space long, t int, bucket long, i int, j int, id long, part int"), "alike")
    width = F.octet_length("raw")
    dims = F.when(width % 4 == 1, F.floor(width / 8)).otherwise(F.floor(width / 4)).cast("int")
    spaced = classes.select("id", "raw", "weight", F.xxhash64("label", dims).alias("space"))
    m = m.join(spaced, ["id", "space"]).repartition(parts, *key).sortWithinPartitions(*key)

    def linked(t: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole blocks that lie one after the other; begins has the first row of each."""
        n = t.num_rows
        ids, weight, part, space_, table, bucket = (t[c].to_numpy() for c in ("id", "weight", "part", "space", "t", "bucket"))
        cross = t["i"].to_numpy() != t["j"].to_numpy()
        raws = t["raw"].to_pylist()
        size = np.array([dimensions(r) for r in raws])
        end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
        for width_ in np.unique(size):  # a block has one size only
            rows_ = np.flatnonzero(size == width_)
            x = np.zeros((n, width_))
            x[rows_] = _units([raws[i] for i in rows_])
            near: list[np.ndarray] = []
            left = (end - np.arange(n) - 1)[rows_]
            for k in range(0, len(rows_), 512):
                some, count = rows_[k : k + 512], left[k : k + 512]
                a = np.repeat(some, count)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
                ok = ~cross[a] | (part[a] != part[b])
                a, b = a[ok], b[ok]
                for q in range(0, len(a), 8192):
                    p, r = a[q : q + 8192], b[q : q + 8192]
                    hit = np.einsum("ij,ij->i", x[p], x[r]) >= least
                    near.append(np.stack((p[hit], r[hit])))
            a, b = np.concatenate(near, 1) if near else np.zeros((2, 0), np.int64)
            if not len(a):
                continue
            used, back = np.unique(np.concatenate((a, b)), return_inverse=True)
            keys = np.concatenate([buckets(x[used[k : k + 2048]]) for k in range(0, len(used), 2048)])
            new, (ia, ib) = np.zeros(len(a), bool), back.reshape(2, -1)
            for k in range(0, len(a), 8192):
                s_ = slice(k, k + 8192)
                ka, kb, t_ = keys[ia[s_]], keys[ib[s_]], table[a[s_]]
                shared = (ka[:, :, :, None] == kb[:, :, None, :]).any(3)
                mine = np.arange(len(t_)), t_
                low = np.where(shared[mine], ka[mine], np.iinfo(np.int64).max).min(1)
                new[s_] = (shared.any(2).argmax(1) == t_) & (low == bucket[a[s_]])
            a, b = a[new], b[new]
            links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            # of the links, those that are enough for the components
            root = list(range(n))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            tied: dict[int, int] = {}
            for i, j in zip(a.tolist(), b.tolist()):
                p, q = top(i), top(j)
                if p != q:
                    root[max(p, q)] = tied[max(p, q)] = min(p, q)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(space_[some]), pa.array(links[some].astype(np.int64)), pa.array([int(ids[tied[i]]) if i in tied else None for i in some.tolist()], pa.int64())], names=["id", "space", "links", "tied"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begins in whole_blocks(batches, key):
            yield from linked(t, begins)

    found = common.cut(m.select(*key, "id", "part", "raw", "weight").mapInArrow(compare, "id long, space long, links long, tied long"), "near")
    links = found.groupBy("id", "space").agg(F.sum("links").alias("others"))
    same = rows.where("raw is not null and label is not null and vec_id is not null").join(classes, ["label", "raw"])
    edges = found.where("tied is not null").select(F.col("id").alias("a"), F.col("tied").alias("b")).union(same.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    reached = common.components(edges, "vectors")
    counted = classes.withColumn("space", F.xxhash64("label", dims)).join(links, ["id", "space"], "left")
    counted = counted.select("label", "raw", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(counted, ["label", "raw"], "left").join(reached.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))


def op9_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
with recursive pairs as (
  select a.vec_id a, b.vec_id b from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.93
), reach as (
  select vec_id, vec_id c from embeddings union select p.b, r.c from reach r join pairs p on p.a = r.vec_id
), comp as (select vec_id, min(c) c from reach group by 1), links as (select a, count(*) n from pairs group by 1)
select e.vec_id, coalesce(n, 0)::bigint n_links, c component_id, e.vec_id = c kept
from embeddings e join comp using (vec_id) left join links on a = e.vec_id
"""
