"""Token ids in wavelet-matrix files: one compressed file a shard, with access, counting and occurrence lookup.

File layout (little-endian): magic b"WMX2", bits u32, n u64, docs u64, the length of the document table u64 and the
table as a zlib stream (a bitmap of null ids, every document's id i64 and length u32), then for every bit-plane, highest
bit first, the number of zeros u64, the ones before every block of BLOCK bytes u32 (a sixteenth of the plane) and the
plane's bits (first bit highest in its byte). Planes and ranks are read where they lie: opening a file copies nothing but
the document table, and an access reads a block of each plane. A file has less than 2**32 ids.

Shards hold ranges of doc_id in ascending order (null ids first; rows of one id by their text), at most about
`limit` ids each. They are rows of a Parquet table in the shared folder, so Spark's commit protocol makes a
shard whole or absent, also when executors are lost, and any store that Spark writes will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens, words


#: distinct pieces of texts that a worker remembers before it begins anew, at some 80 bytes each
REMEMBERED = 1 << 21


class WaveletMatrix:
    """Bit-planes of a sequence of ids, each plane stably sorted by the bits above."""

    BLOCK = 64  # bytes of a rank block

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int, ranks: list[np.ndarray]):
        self.planes, self.zeros, self.n, self.ranks = planes, zeros, n, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (a & a.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit))
            ranks.append(cls.ones_before(planes[-1]))
            low = a.compress(~bit)
            zeros.append(len(low))
            a = np.concatenate((low, a.compress(bit)))
        return cls(planes, zeros, len(ids), ranks)

    @classmethod
    def ones_before(cls, plane: np.ndarray) -> np.ndarray:
        """The ones before every block, and all of them at the end."""
        whole = np.zeros(-(-len(plane) // cls.BLOCK) * cls.BLOCK, np.uint8)
        whole[: len(plane)] = plane
        counts = np.bitwise_count(whole.view(np.uint64)).reshape(-1, cls.BLOCK // 8).sum(1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)))

    def all(self) -> np.ndarray:
        """The whole sequence, by undoing the sorts from the lowest plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for k in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = a[: self.zeros[k]]
            up[np.flatnonzero(bit)] = a[self.zeros[k] :] | kind(1 << (bits - 1 - k))
            a = up
        return a.astype(np.uint32)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, rest = divmod(i, 8 * self.BLOCK)
        out = int(self.ranks[k][block])
        at = block * self.BLOCK
        full, bits = divmod(rest, 8)
        out += int(np.bitwise_count(self.planes[k][at : at + full]).sum())
        return out + (int(self.planes[k][at + full]) >> (8 - bits)).bit_count() if bits else out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(len(self.planes)):
            bit = self.planes[k][i >> 3] >> (7 - (i & 7)) & 1
            out = out << 1 | int(bit)
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
        return out

    def _range(self, x: int, lo: int, hi: int) -> tuple[int, int]:
        bits = len(self.planes)
        for k in range(bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if x >> (bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, x: int, lo: int = 0, hi: int | None = None) -> int:
        """How often x occurs in [lo, hi)."""
        if x >> len(self.planes):
            return 0
        a, b = self._range(x, lo, self.n if hi is None else hi)
        return b - a

    def _place(self, k: int, one: int, rank: int) -> int:
        """Place of the rank-th one (or zero) of plane k: its block by bisection of the ranks, then within it."""
        ranks, width = self.ranks[k], 8 * self.BLOCK
        before = lambda b: int(ranks[b]) if one else b * width - int(ranks[b])
        lo, hi = 0, len(ranks) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= rank else (lo, mid)
        bits = np.unpackbits(self.planes[k][lo * self.BLOCK : (lo + 1) * self.BLOCK]) == one
        return lo * width + int(np.flatnonzero(bits)[rank - before(lo)])

    def select(self, x: int, j: int) -> int:
        """Index of the j-th occurrence of x (from 0), or -1."""
        if x >> len(self.planes):
            return -1
        lo, hi = self._range(x, 0, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i, bits = lo + j, len(self.planes)
        for k in range(bits - 1, -1, -1):
            one = x >> (bits - 1 - k) & 1
            rank = i - self.zeros[k] if one else i
            i = self._place(k, one, rank)
        return i


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    m = WaveletMatrix.build(ids, bits)
    null = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    docs = zlib.compress(b"".join([null, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes()]), 1)
    body = [b"WMX2", struct.pack("<IQQQ", bits, m.n, len(doc_ids), len(docs)), docs]
    for z, r, p in zip(m.zeros, m.ranks, m.planes):
        body += [struct.pack("<Q", z), r.astype("<u4").tobytes(), p.tobytes()]
    return b"".join(body)


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix of one file."""
    if blob[:4] != b"WMX2":
        raise ValueError("not a wavelet-matrix file")
    bits, n, docs, size = struct.unpack_from("<IQQQ", blob, 4)
    at = 4 + struct.calcsize("<IQQQ")
    raw = zlib.decompress(blob[at : at + size])
    at += size
    flags = -(-docs // 8)
    null = np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=docs)
    ids = np.frombuffer(raw, "<i8", docs, flags).tolist()
    lengths = np.frombuffer(raw, "<u4", docs, flags + 8 * docs).astype(np.int64)
    planes, zeros, ranks, size = [], [], [], -(-n // 8)
    blocks = -(-size // WaveletMatrix.BLOCK) + 1
    for _ in range(bits):
        zeros.append(struct.unpack_from("<Q", blob, at)[0])
        ranks.append(np.frombuffer(blob, "<u4", blocks, at + 8))
        planes.append(np.frombuffer(blob, np.uint8, size, at + 8 + 4 * blocks))
        at += 8 + 4 * blocks + size
    return [None if x else d for d, x in zip(ids, null)], lengths, WaveletMatrix(planes, zeros, n, ranks)


def write_shards(documents: DataFrame, tokenizer: str, end_id: int, limit: int = 1 << 21) -> DataFrame:
    """Encodes all documents and writes the files: a table of (shard, part, docs, n_tokens, payload)."""
    docs = common.one_column(documents, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    dealt = docs.repartitionByRange(common.partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(tokenizer, remembered=REMEMBERED)
        bits = max(1, int(max(e.library.get_vocab_size() - 1, end_id)).bit_length())
        shard, part = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        held: list[int | None] = []
        lengths: list[int] = []

        def out() -> pa.RecordBatch:
            blob = pack(held, lengths, np.concatenate(ids), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([blob], pa.binary())],
                names=["shard", "part", "docs", "n_tokens", "payload"],
            )

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                flat, starts, _ = e.encode(piece.column(1))
                for d, a, b in zip(piece.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    ids += [flat[a:b], end]
                    held.append(d)
                    lengths.append(b - a + 1)
                if sum(lengths) >= limit:
                    yield out()
                    ids, held, lengths, part = [], [], [], part + 1
        if held:
            yield out()

    return common.cut(dealt.mapInArrow(encode, "shard int, part int, docs long, n_tokens long, payload binary"), "wavelet")


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    # ids before a file: in its range of doc_ids by a window, and in the ranges before, of which there are as many as
    # shuffle partitions
    upto = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    ranges = ranges.select("shard", upto(Window.orderBy("shard")).alias("base"))
    sizes = shards.select("shard", "part", "n_tokens").withColumn("within", upto(Window.partitionBy("shard").orderBy("part")))
    before = sizes.join(ranges, "shard").select("shard", "part", (F.col("within") + F.col("base")).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, part, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids, lengths, matrix = unpack(blob)
                flat = memoryview(matrix.all().astype("<u4", copy=False)).cast("B")
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(flat[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["shard", "part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("shard", "part", "payload").mapInArrow(decode, "shard int, part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(before, ["shard", "part"]).select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op3_wavelet_ids(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json", 2))
