"""Sequence packing as a cutting-stock problem, solved by column generation on a length histogram.

1. Each document's ids (with the end id) are cut into pieces of `length` and a rest. Rests are counted in size classes
   whose tops are exact up to EXACT and then STEPS to each doubling, so the histogram has a bounded number of bins.
2. A linear program over patterns (numbers of pieces of each class that fit one sequence) is solved by the simplex
   method; an unbounded knapsack over the dual prices supplies each entering column. Pattern counts are rounded down and
   what is left is packed largest first. Pieces are ranked within their classes and take the patterns' slots in order.
3. What the classes and patterns leave open in a sequence is filled by free cuts: sequences from the end of the list are
   taken apart and their pieces, in a row, are cut where the open places, in a row, end. So padding stays small for any
   lengths (also such of which no two fit a sequence), and few documents are cut. Rows lie on a line of ids that is dealt
   in cells of CELL ids, so no task holds more than a cell's pieces.

Null or empty text: the end id alone. Null and repeated doc_ids are documents like others. No rows: no pieces. Texts of
any length are read whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens, words

EXACT = 64
STEPS = 32
#: the linear program ends within this share of its optimum; what that leaves open is filled by cuts
GAP = 5e-4
#: runs of sequences, of which the last are taken apart
BLOCKS = 4096
CELL = 1 << 16


def size_tops(length: int) -> np.ndarray:
    """The largest size of every class, up to `length`."""
    out, top, step = [], 0, 1
    while top < length:
        top += step
        out.append(min(top, length))
        if top >= EXACT and top & (top - 1) == 0:
            step = max(1, top // STEPS)
    return np.array(out, np.int64)


def best_column(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable pattern of items with these sizes.

    Items come by falling price a place; one that others already fill its size with for as much is passed over. An item's
    best number at every capacity is a running maximum along capacities that lie its size apart.
    """
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for j in np.argsort(-prices / sizes, kind="stable").tolist():
        p, s = float(prices[j]), int(sizes[j])
        if s > capacity or p <= value[s] + 1e-12:
            continue
        rows = capacity // s + 1
        apart = np.full(rows * s, -np.inf)
        apart[: capacity + 1] = value
        paid = p * np.arange(rows)[:, None]
        new = (np.maximum.accumulate(apart.reshape(rows, s) - paid, axis=0) + paid).ravel()[: capacity + 1]
        up = new > value + 1e-12
        value[up] = new[up]
        took[up] = j
    column, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        j = took[c]
        if j < 0:
            c -= 1
        else:
            column[j] += 1
            c -= sizes[j]
    return float(column @ prices), column


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: number} and how often to use each, so that exactly `counts` pieces of each size are placed.

    Columns are added until their number is proven to be within GAP of the linear program's optimum, however many that takes.
    """
    sizes = np.array(sorted(s for s, c in counts.items() if c), np.int64)
    if not len(sizes):
        return []
    demand = np.array([counts[int(s)] for s in sizes], np.float64)
    m, least = len(sizes), float(sizes @ demand) / capacity
    # first basis: patterns filled largest first, each used until one of its sizes is exhausted; later ones lack that
    # size, so the basis is triangular and feasible
    columns, x, left, open_ = np.zeros((m, m)), np.zeros(m), demand.copy(), set(range(m))
    for k in range(m):
        if not left.any():  # several sizes were exhausted at once
            columns[open_.pop(), k] = 1
            continue
        room = capacity
        for i in np.flatnonzero(left > 0)[::-1].tolist():
            n = min(int(np.ceil(left[i])), room // int(sizes[i]))
            columns[i, k] = n
            room -= n * int(sizes[i])
        some = np.flatnonzero(columns[:, k])
        done = some[(left[some] / columns[some, k]).argmin()]
        open_.discard(int(done))
        x[k] = left[done] / columns[done, k]
        left -= x[k] * columns[:, k]
        left[done] = 0
        left[left < 1e-9] = 0
    # counts a little higher, so that columns never tie in leaving and no basis comes again
    x += 1e-7 * np.maximum(x, 1) * np.arange(1, m + 1) / m
    wanted, inverse, k = columns @ x, np.linalg.inv(columns), 0
    while x.sum() > (1 + GAP) * least:
        value, column = best_column(inverse.sum(0), sizes, capacity)
        least = max(least, x.sum() / value)  # the optimum is at least that (Farley)
        d = inverse @ column
        up = d > 1e-10
        if x.sum() <= (1 + GAP) * least or not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / d[up]
        r = int(ratio.argmin())
        columns[:, r] = column
        k += 1
        if k % 200 == 0:  # rounding errors do not add up
            inverse = np.linalg.inv(columns)
            x = inverse @ wanted
        else:
            step = ratio[r]
            x -= step * d
            x[r] = step
            inverse[r] /= d[r]
            others = np.arange(m) != r
            inverse[others] -= np.outer(d[others], inverse[r])
    out, left = [], demand.astype(np.int64)
    for j in np.argsort(-x):
        column = columns[:, j].astype(np.int64)
        some = column > 0
        n = int(min(np.floor(max(x[j], 0) + 1e-6), (left[some] // column[some]).min())) if some.any() else 0
        if n > 0:
            out.append(({int(s): int(c) for s, c in zip(sizes, column) if c}, n))
            left -= n * column
    while left.any():
        room, column = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        n = int((left[column > 0] // column[column > 0]).min())
        out.append(({int(s): int(c) for s, c in zip(sizes, column) if c}, n))
        left -= n * column
    return out


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int, sent=None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, doc_hash, bin) of every piece of docs (doc_id, text).

    With a filter `sent` over ids (null counts as -1), only documents that pass it, and their ids as little-endian bytes. The
    worker that encodes looks it up: a worker of its own would hold every text once more.
    """
    tops, with_ids = size_tops(length), sent is not None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, bits = tokens.encoder(tokenizer), np.unpackbits(sent.value) if with_ids else None
        for batch in batches:
            if with_ids:
                batch = batch.filter(pa.array(common.passes(bits, batch.column(0).fill_null(-1))))
            for piece in words.pieces(batch, "text"):
                flat, starts, _ = e.encode(piece.column(1))
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                raw: list[bytes] = []
                for d, a, b in zip(piece.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    ids = memoryview(np.append(flat[a:b], np.uint32(end_id)).astype("<u4")).cast("B")
                    n, h = b - a + 1, int.from_bytes(hashlib.blake2b(ids, digest_size=8).digest(), "little", signed=True)
                    for s in range(0, n, length):
                        size = min(length, n - s)
                        for col, v in zip(rows, (d, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, h)):
                            col.append(v)
                        if with_ids:
                            raw.append(bytes(ids[4 * s : 4 * (s + size)]))
                bins = np.searchsorted(tops, np.array(rows[2], np.int64)).astype(np.int32)
                cols = [*(pa.array(c, pa.int64()) for c in rows), pa.array(bins), *([pa.array(raw, pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_hash", "bin", "ids"][: len(cols)])

    return docs.mapInArrow(encode, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_hash long, bin int" + ", ids binary" * with_ids)


def _placed(pieces: DataFrame, length: int) -> tuple[DataFrame, int]:
    """The pieces with sequence_id and their order nth in it, by patterns; the number of sequences."""
    tops = size_tops(length)
    by_deal = pieces.groupBy("bin", "deal").count()
    counts = {r["bin"]: r["n"] for r in by_deal.groupBy("bin").agg(F.sum("count").alias("n")).collect()}

    # slots of each bin in order: (first rank, first sequence, pieces of the bin in the pattern, pieces before them)
    slots: dict[int, list[tuple[int, int, int, int]]] = {b: [] for b in counts}
    taken, sequence, bin_of = dict.fromkeys(counts, 0), 0, {int(tops[b]): b for b in counts}
    for pattern, n in patterns({int(tops[b]): c for b, c in counts.items()}, length):
        before = 0
        for size in sorted(pattern, reverse=True):
            b, c = bin_of[size], pattern[size]
            slots[b].append((taken[b], sequence, c, before))
            taken[b] += n * c
            before += c
        sequence += n
    sent = pieces.sparkSession.sparkContext.broadcast({b: np.array(s, np.int64).reshape(-1, 4) for b, s in slots.items()})

    base = by_deal.withColumn("base", F.sum("count").over(Window.partitionBy("bin").orderBy("deal")) - F.col("count")).select("bin", "deal", "base")
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("bin", "deal").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "doc_hash")))
    ranked = ranked.join(base, ["bin", "deal"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_hash", "bin", (F.col("base") + F.col("row") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.let_go()
        for b in batches:
            bins, rank = b.column(6).to_numpy(), b.column(7).to_numpy()
            seq, nth = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(bins):
                at = bins == x
                t = sent.value[int(x)]
                row = np.searchsorted(t[:, 0], rank[at], "right") - 1
                within, each = rank[at] - t[row, 0], t[row, 2]
                seq[at], nth[at] = t[row, 1] + within // each, t[row, 3] + within % each
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(seq), pa.array(nth)], names=[*b.schema.names[:6], "sequence_id", "nth"])

    out = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_hash long, sequence_id long, nth long")
    order = Window.partitionBy("sequence_id").orderBy("nth")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return out.withColumn("offset", offset), sequence


def _on_a_line(rows: DataFrame, order: list[str], size: str, bases: DataFrame) -> DataFrame:
    """Rows with their place `at` when all lie in a row by block and order, once for each cell they touch."""
    at = F.sum(size).over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    out = rows.withColumn("at", at).join(bases, "block").withColumn("at", F.col("at") + F.col("base")).drop("base", "block")
    return out.withColumn("cell", F.explode(F.sequence((F.col("at") / CELL).cast("long"), ((F.col("at") + F.col(size) - 1) / CELL).cast("long"))))


def _filled(placed: DataFrame, docs: DataFrame, sequences: int, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """The result: open places of sequences hold the pieces of sequences from the end of the list."""
    spark, columns = placed.sparkSession, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    each = max(1, -(-sequences // BLOCKS))
    block = F.floor(F.col("sequence_id") / F.lit(each)).cast("long").alias("block")
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    sums = dict(placed.groupBy(block).agg(F.sum("length")).collect())  # at most BLOCKS numbers
    n = -(-sequences // each)
    room = [min(sequences, (b + 1) * each) * length - b * each * length - sums.get(b, 0) for b in range(n)]
    last, donated, open_ = n, 0, sum(room)
    while last and donated + sums.get(last - 1, 0) <= open_ - room[last - 1]:
        last -= 1
        donated += sums.get(last, 0)
        open_ -= room[last]
    if not donated:
        return placed.select(columns)

    def bases(sizes: list[int], first: int) -> DataFrame:
        ends = np.cumsum([0, *sizes])
        # from Arrow: rows of Python objects go through workers of their own, with a daemon that stays
        return spark.createDataFrame(pa.table({"block": np.arange(first, first + len(sizes)), "base": ends[:-1].astype(np.int64)}))

    stay, go = placed.where(F.col("sequence_id") < last * each), placed.where(F.col("sequence_id") >= last * each)
    gaps = used.where(F.col("sequence_id") < last * each).select("sequence_id", "used", (F.lit(length) - F.col("used")).alias("room"), block).where("room > 0")
    gaps = _on_a_line(gaps, ["sequence_id"], "room", bases(room[:last], 0))
    go = _on_a_line(go.select("doc_id", "start", "length", "doc_tokens", "doc_hash", "sequence_id", "nth", block), ["sequence_id", "nth"], "length", bases([sums.get(b, 0) for b in range(last, n)], last))
    # the ids of the pieces that go: only their documents are encoded again
    sent = common.id_filter(go.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")))
    ids = cut_documents(docs, tokenizer, end_id, length, sent).groupBy("doc_id", "start", "doc_tokens", "doc_hash").agg(F.first("ids").alias("ids"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("doc_id", "start", "doc_tokens", "doc_hash")]
    go = go.alias("p").join(ids.alias("i"), same[0] & same[1] & same[2] & same[3]).select("cell", "at", F.col("p.length").alias("size"), F.lit(1).alias("role"), F.col("p.doc_id"), F.col("p.start"), F.col("p.doc_tokens"), "ids", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("used"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    gaps = gaps.select("cell", "at", F.col("room").alias("size"), F.lit(0).alias("role"), none("doc_id", "long"), none("start", "long"), none("doc_tokens", "long"), none("ids", "binary"), "sequence_id", "used")
    both = gaps.unionByName(go).repartition(common.partitions(docs), "cell").sortWithinPartitions("cell", "role", "at")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.let_go()
        for t in common.groups(batches, ["cell"]):
            at, size, role = (t[c].to_numpy() for c in ("at", "size", "role"))
            low = int(t["cell"][0].as_py()) * CELL
            g, p = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(g) or not len(p):
                continue
            begin, end = max(low, int(at[p[0]])), min(low + CELL, int(at[p[-1]] + size[p[-1]]))
            cuts = np.unique(np.clip(np.concatenate((at[g], at[p], [begin, end])), begin, end))
            lo, hi = cuts[:-1], cuts[1:]
            gap, piece = g[np.searchsorted(at[g], lo, "right") - 1], p[np.searchsorted(at[p], lo, "right") - 1]
            shift = lo - at[piece]
            raw = t["ids"].take(pa.array(piece)).to_pylist()
            crc = [zlib.crc32(memoryview(x)[4 * a : 4 * (a + k)]) for x, a, k in zip(raw, shift.tolist(), (hi - lo).tolist())]
            pick = lambda c, rows: t[c].take(pa.array(rows)).combine_chunks()
            start = pick("start", piece).to_numpy() + shift
            offset = pick("used", gap).to_numpy() + lo - at[gap]
            yield pa.RecordBatch.from_arrays([pick("doc_id", piece), pa.array(start), pa.array(hi - lo), pa.array(crc, pa.int64()), pick("doc_tokens", piece), pick("sequence_id", gap), pa.array(offset)], names=columns)

    return stay.select(columns).union(both.mapInArrow(merge, ", ".join(f"{c} long" for c in columns)))


def pack(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, length: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = common.one_column(documents, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    deal = F.pmod(F.xxhash64("doc_id", "start", "doc_hash"), F.lit(common.partitions(documents))).cast("int").alias("deal")
    pieces = common.cut(cut_documents(docs, tokenizer, end_id, length).select("*", deal), "pieces")
    placed, sequences = _placed(pieces, length)
    placed = common.cut(placed, "placed")
    common.drop(pieces)
    return _filled(placed, docs, sequences, tokenizer, end_id, length)


def op6_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
