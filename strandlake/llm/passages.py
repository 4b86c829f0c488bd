"""Repeated passages across documents by collinear chaining of shared k-mer seeds.

1. Seeds: the runs of K words whose hash has a remainder of 0 by EVERY, whatever stands around them, and those that
   repeat one to three words, since a text of such runs has too few different ones to choose from; their places are
   counted anew after every WRAP. Words are lower-cased runs of letters and digits.
2. A seed's place in a document and its place in the document before (by doc_id) that holds the seed are an anchor: the
   n-th place there, or else the first. So n copies give n - 1 anchors a seed, and a passage meets the latest document
   that holds it, also where parts of it stand in other documents. Seeds that a sample shows to be frequent are dealt
   over SPREAD ranges of doc_id, and the ranges are joined at their ends, so no task holds all places of a hot seed.
3. Chains: anchors of a document and one before it that touch on one diagonal are a run, which is an exact match. Runs in
   increasing order of both places, up to REACH words apart, are chained by one rule for all, with a cost for every word
   between them; Fenwick trees over the places hold the best chains that end in the words before each place. A lone seed
   of K words is no chain: a passage of LEAST words that is alike in five of six words has 12 seeds and more.
4. Alignment: words in the gaps between a chain's anchors and up to FLANK words beyond its ends are fetched for both
   documents (as 24 bits of their hashes) and aligned in a band; the chain grows as long as the alignment gains, and its
   identity is counted.
5. Passages: a document's aligned chains of at least PART words that touch (up to JOIN words apart) are joined;
   those of at least `least` words count.

A repeated passage is reported for every document but the first; null doc_ids and texts have none, empty texts neither.
Rows of one doc_id are one document that holds each of their texts and never repeats itself. Texts of any length are
read whole; other columns are not looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

K = 5
EVERY = 2
LEAST = 45
PART = 20
JOIN = 4
FLANK = 48
BAND = 6
MAX_GAP = 40
#: places from one anchor of a chain to the next at most
REACH = MAX_GAP + K
#: even the widest gap that a chain may have costs less than one seed's words
GAP_COST = 0.05
CHUNK = 256
WRAP = 40
#: places of a seed beyond which its documents are dealt over SPREAD ranges of ids
HOT = 2000
SPREAD = 64
#: documents among which frequent seeds are looked for, and how many seeds at most are dealt so
SAMPLE = 20_000
HOT_SEEDS = 1 << 17


def seeds(documents: DataFrame, hot: np.ndarray | None = None, cuts: list[int] | None = None) -> DataFrame:
    """(seed, doc_id, place, nth, part) of every seed of every document; nth counts the places of one seed in a document.

    part is 0, and for the seeds in `hot` (sorted) the range between `cuts` in which doc_id lies, from 1 on.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((np.zeros(0, np.int64) if hot is None else hot, np.array(cuts or [], np.int64)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, ends = sent.value
        for batch in batches:
            for b in words.pieces(batch, "text"):
                h, first = words.word_hashes(b.column(1), words.LETTER_WORDS)
                r = words.runs(h, K)
                if not len(r):
                    continue
                periodic = np.zeros(len(r), bool)
                for p in (1, 2, 3):
                    again = np.append(h[:-p] == h[p:], np.zeros(p, bool))
                    periodic |= np.logical_and.reduce([again[i : i + len(r)] for i in range(K - p)])
                at = np.flatnonzero(periodic | (r % np.uint64(EVERY) == 0))
                d = np.searchsorted(first, at, "right") - 1
                inside = at + K <= first[1:][d]
                at, d = at[inside], d[inside]
                seed = r[at]
                mixed = seed + words.mix(d.astype(np.uint64))
                order = np.argsort(mixed, kind="stable")
                begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), np.diff(mixed[order]) != 0)))
                nth = np.empty(len(at), np.int32)
                nth[order] = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                nth[periodic[at]] %= WRAP
                ids, seed = b.column(0).to_numpy()[d], seed.view(np.int64)
                part = np.zeros(len(at), np.int32)
                if len(often):
                    k = np.minimum(np.searchsorted(often, seed), len(often) - 1)
                    some = np.flatnonzero(often[k] == seed)
                    part[some] = np.searchsorted(ends, ids[some]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ids), pa.array((at - first[:-1][d]).astype(np.int32)), pa.array(nth), pa.array(part)], names=["seed", "doc_id", "place", "nth", "part"])

    return documents.where("doc_id is not null").mapInArrow(find, "seed long, doc_id long, place int, nth int, part int")


def exact_runs(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of groups (each begins where `new`) in an order by runs, and where in it runs begin.

    A run is an exact match: anchors of one diagonal of which each lies K words after the one before at most.
    """
    group, diagonal = np.cumsum(new), y - x
    order = np.lexsort((x, diagonal, group))
    first = np.ones(len(x), bool)
    first[1:] = (np.diff(group[order]) != 0) | (np.diff(diagonal[order]) != 0) | (np.diff(x[order]) > K)
    return order, first


def run_chains(hx: list[int], hy: list[int], tx: list[int], ty: list[int]) -> list[list[int]]:
    """Chains of runs, given by the places of their first (hx, hy) and last (tx, ty) anchors, those of the highest score
    first, each run in at most one.

    A run may follow one whose last anchor lies before its first in both texts, by REACH words at most. A chain's score is
    its runs' words less GAP_COST for every word from a run's last anchor to the next one's first, in both texts. Places y
    are cut into strips of REACH; each has a Fenwick tree from its begin and one from its end, so two lookups cover just
    the REACH words before a place. A tree's node is a queue of falling scores, which forgets what lies too far before in x.
    """
    n = len(hx)
    best, score = [-1] * n, [0.0] * n
    order, ends = sorted(range(n), key=lambda i: (hx[i], hy[i])), sorted(range(n), key=lambda i: (tx[i], ty[i]))
    strips: dict[int, tuple[list, list]] = {}
    done = 0
    for i in order:
        while tx[ends[done]] < hx[i]:  # runs that end before this one begins; they have their scores
            j = ends[done]
            done += 1
            strip, off = divmod(ty[j], REACH)
            value = score[j] + GAP_COST * (tx[j] + ty[j])
            for tree, at in zip(strips.setdefault(strip, ([None] * (REACH + 1), [None] * (REACH + 1))), (off + 1, REACH - off)):
                while at <= REACH:
                    queue = tree[at]
                    if queue is None:
                        queue = tree[at] = deque()
                    while queue and queue[-1][1] <= value:
                        queue.pop()
                    queue.append((tx[j], value, j))
                    at += at & -at
        strip, off = divmod(hy[i], REACH)
        top, before = 0.0, -1
        for number, side, at in ((strip, 0, off), (strip - 1, 1, REACH - off)):
            trees = strips.get(number)
            while trees and at:
                queue = trees[side][at]
                while queue and queue[0][0] < hx[i] - REACH:
                    queue.popleft()
                if queue and queue[0][1] > top:
                    _, top, before = queue[0]
                at -= at & -at
        gain = top - GAP_COST * (hx[i] + hy[i])
        score[i] = tx[i] - hx[i] + K + max(0.0, gain)
        best[i] = before if gain > 0 else -1
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = best[i]
        if chain:
            out.append(chain[::-1])
    return out


def grow(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best banded extension alignment of two sequences from their beginnings: words used of each, and matches."""
    n = min(len(a), len(b))
    same = int(np.argmin(np.append(a[:n] == b[:n], False)))
    if same == len(a) or same == len(b):
        return same, same, same
    a, b = a[same:].tolist(), b[same:].tolist()
    # score 1 for a match, -1 else; cells (score, matches) of one row within the band
    row = {j: (-j, 0) for j in range(min(len(b), BAND) + 1)}
    top = (0, 0, 0, 0)
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - BAND), min(len(b), i + BAND) + 1):
            options = []
            if j and j - 1 in row:
                s, m = row[j - 1]
                options.append((s + 1, m + 1) if a[i - 1] == b[j - 1] else (s - 1, m))
            if j in row:
                options.append((row[j][0] - 1, row[j][1]))
            if j - 1 in new:
                options.append((new[j - 1][0] - 1, new[j - 1][1]))
            if options:
                new[j] = max(options)
                if new[j][0] > top[0]:
                    top = (new[j][0], i, j, new[j][1])
        row = new
        if not row or max(s for s, _ in row.values()) < top[0] - 10:
            break
    return same + top[1], same + top[2], same + top[3]


def grow_many(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """grow() of many pairs of sequences of non-negative numbers at once, one row each."""
    la, lb = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    out = np.zeros((len(a), 3), np.int64)
    if not len(a) or not min(la.max(), lb.max()):
        return out
    size = int(max(la.max(), lb.max()))
    pad = np.full((2, len(a), size + 1), -1, np.int64)
    for p, s, n in ((pad[0], a, la), (pad[1], b, lb)):
        p[:, :size][np.arange(size) < n[:, None]] = np.concatenate(s)
    same = ((pad[0] != pad[1]) | (pad[0] < 0)).argmax(1)
    out[:] = same[:, None]
    k = np.flatnonzero((same < la) & (same < lb))
    if not len(k):
        return out
    at = np.minimum(same[k, None] + np.arange(size + 1), size)
    x, y = np.take_along_axis(pad[0][k], at, 1), np.take_along_axis(pad[1][k], at, 1)
    y = np.pad(y, ((0, 0), (BAND, BAND)), constant_values=-1)
    nx, ny, base = la[k] - same[k], lb[k] - same[k], same[k]
    # a cell is score * unit + matches; column o of row i is the place j = i + o - BAND
    unit, off, none = 1024, np.arange(2 * BAND + 1), -(1 << 40)
    j = off - BAND
    row = np.where((j >= 0) & (j <= ny[:, None]), -j * unit, none)
    top, best = np.zeros(len(k), np.int64), np.zeros((len(k), 3), np.int64)
    for i in range(1, size + 1):
        go = i <= nx
        if not go.all():
            out[k[~go]] = base[~go, None] + best[~go]
            k, x, y, nx, ny, base, row, top, best = (v[go] for v in (k, x, y, nx, ny, base, row, top, best))
        if not len(k):
            break
        j = i + off - BAND
        equal = y[:, i - 1 : i + 2 * BAND] == x[:, i - 1, None]
        new = np.where(j >= 1, row + np.where(equal, unit + 1, -unit), none)
        new[:, :-1] = np.maximum(new[:, :-1], row[:, 1:] - unit)
        new[:, (j < 0)] = none
        new = np.maximum.accumulate(new + off * unit, axis=1) - off * unit
        new[(j < 0) | (j > ny[:, None])] = none
        score = new // unit
        o = score.argmax(1)
        n = np.arange(len(k))
        most = score[n, o]
        up = most > top
        top[up] = most[up]
        best[up, 0], best[up, 1], best[up, 2] = i, j[o[up]], (new - score * unit)[n, o][up]
        go, row = most >= top - 10, new
        if not go.all():
            out[k[~go]] = base[~go, None] + best[~go]
            k, x, y, nx, ny, base, row, top, best = (v[go] for v in (k, x, y, nx, ny, base, row, top, best))
    if len(k):
        out[k] = base[:, None] + best
    return out


def matches(a: np.ndarray, b: np.ndarray) -> int:
    """Matching words of a banded global alignment of two gaps."""
    if not len(a) or not len(b):
        return 0
    band, n = BAND + abs(len(a) - len(b)), min(len(a), len(b))
    # what is equal from the beginning and from the end stays so
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    tail = int(np.argmin(np.append((a[::-1][: n - head] == b[::-1][: n - head]), False)))
    a, b = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    row = [0] * (len(b) + 1)
    for i, w in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j in range(1, len(b) + 1):
            new[j] = max(row[j], new[j - 1], row[j - 1] + (w == b[j - 1] and abs(i - j) <= band))
        row = new
    return head + tail + row[-1]


_NAMES = ["doc_id", "owner", "begin", "end", "owner_begin", "owner_end", "solid", "cuts", "owner_cuts"]


def linked(d: np.ndarray, o: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Chains of two anchors and more of whole groups (document, owner) that lie one after the other, sorted by places."""
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(d) != 0) | (np.diff(o) != 0) | (np.diff(x) > REACH)  # anchors further apart never share a chain
    order, first = exact_runs(x, y, new)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(order)))
    head, tail = order[begin], order[begin + size - 1]
    group = np.flatnonzero(np.append(True, np.diff(np.cumsum(new)[head]) != 0)) if len(head) else begin
    runs = np.diff(np.append(group, len(begin)))
    numbers, starts = [group[runs == 1]], [np.ones(int((runs == 1).sum()), bool)]  # a single run is its own chain
    for g, n in zip(group[runs > 1].tolist(), runs[runs > 1].tolist()):
        at = slice(g, g + n)
        for c in run_chains(x[head[at]].tolist(), y[head[at]].tolist(), x[tail[at]].tolist(), y[tail[at]].tolist()):
            numbers.append(np.array(c) + g)
            starts.append(np.arange(len(c)) == 0)
    number, start = np.concatenate(numbers), np.concatenate(starts)
    before = np.cumsum(size[number]) - size[number]
    rows = order[np.repeat(begin[number] - before, size[number]) + np.arange(len(order))]
    first = np.zeros(len(rows), bool)
    first[before[start]] = True
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(rows)))
    keep = np.repeat(size > 1, size)
    rows, first = rows[keep], first[keep]
    begin = np.flatnonzero(first)
    end = (np.append(begin[1:], len(rows)) - 1)[: len(begin)]
    cx, cy = x[rows], y[rows]
    # words between anchors: from one's end to the next's begin, in both texts
    dx, dy = np.diff(cx, prepend=0), np.diff(cy, prepend=0)
    open_ = ~first & ((dx != dy) | (dx > K))
    solid = np.where(first, K, np.where(open_, np.minimum(np.minimum(dx, dy), K), dx))
    solid = np.add.reduceat(solid, begin) if len(begin) else np.zeros(0, np.int64)
    at = np.flatnonzero(open_)
    edges = np.concatenate(([0], np.cumsum(np.add.reduceat(open_.astype(np.int64), begin) if len(begin) else []))).astype(np.int32) * 2
    gaps = [pa.ListArray.from_arrays(edges, pa.array(np.stack((np.minimum(c[at - 1] + K, c[at]), c[at]), 1).ravel().astype(np.int32))) for c in (cx, cy)]
    numbers = [cx[begin], cx[end] + K, cy[begin], cy[end] + K, solid]
    return pa.RecordBatch.from_arrays([pa.array(d[rows[begin]]), pa.array(o[rows[begin]]), *(pa.array(v.astype(np.int32)) for v in numbers), *gaps], names=_NAMES)


def _chained(anchors: DataFrame) -> DataFrame:
    """(chain, doc_id, owner, begin, end, owner_begin, owner_end, solid, cuts, owner_cuts) of every chain."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate((h, batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64))) for h, c in zip(held, ("doc_id", "owner", "place", "owner_place"))]
            if not len(held[0]):
                continue
            # the last group may go on in the next batch
            last = int(np.flatnonzero(np.concatenate(([True], (np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))))[-1])
            if last:
                yield linked(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield linked(*held)

    sorted_ = anchors.repartition(common.partitions(anchors), "doc_id").sortWithinPartitions("doc_id", "owner", "place", "owner_place")
    out = sorted_.mapInArrow(chain, "doc_id long, owner long, begin int, end int, owner_begin int, owner_end int, solid int, cuts array<int>, owner_cuts array<int>")
    return out.withColumn("chain", F.xxhash64("doc_id", "owner", "begin", "owner_begin", "end", "owner_end"))


def _fetched(chained: DataFrame, documents: DataFrame) -> DataFrame:
    """(chain, side, doc_id, other, lo, hi, solid, words, sizes): the words of every chain's gaps and flanks in one document."""
    side = lambda s, d, e, lo, hi, c: chained.select(F.col(d).alias("doc_id"), F.struct("chain", F.lit(s).alias("side"), F.col(e).alias("other"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), "solid", F.col(c).alias("cuts")).alias("ask"))
    asks = side(0, "doc_id", "owner", "begin", "end", "cuts").union(side(1, "owner", "doc_id", "owner_begin", "owner_end", "owner_cuts"))
    ids = asks.select("doc_id").groupBy("doc_id").count()
    # a document that many chains ask for is asked in parts; a table, so that a join with it can be split
    parts = common.cut(ids.where(f"count > {CHUNK}").select("doc_id", F.ceil(F.col("count") / F.lit(CHUNK)).alias("parts")), "parts")
    asks = asks.join(parts, "doc_id", "left").withColumn("salt", F.pmod(F.xxhash64("ask.chain"), F.coalesce("parts", F.lit(1)))).drop("parts")
    asks = asks.repartition(common.partitions(documents), "doc_id", "salt").groupBy("doc_id", "salt").agg(F.collect_list("ask").alias("asks"))
    asks = common.cut(asks, "asks")
    texts = common.passing(documents, "doc_id", common.id_filter(asks.select("doc_id")))
    names = ["chain", "side", "doc_id", "other", "lo", "hi", "solid", "words", "sizes"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.pieces(batch, "text"):
                h, first = words.word_hashes(b.column(0), words.LETTER_WORDS)
                low = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3])
                counts = pc.list_value_length(b.column(2)).to_numpy()
                asks_ = b.column(2).flatten()
                chain, side_, other, lo, hi, solid = (asks_.field(asks_.type.get_field_index(c)) for c in ("chain", "side", "other", "lo", "hi", "solid"))
                cuts = asks_.field(asks_.type.get_field_index("cuts"))
                edges, ends = cuts.flatten().to_numpy().reshape(-1, 2), np.cumsum(pc.list_value_length(cuts).to_numpy()) // 2
                row = np.repeat(np.arange(b.num_rows), counts)
                begin, size = first[:-1][row], np.diff(first)[row]
                raw, sizes = [], []
                for f, n, x, y, a, z in zip(begin.tolist(), size.tolist(), lo.to_pylist(), hi.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    got = [(max(0, x - FLANK), min(x, n)), (min(y, n), min(y + FLANK, n)), *np.minimum(edges[a:z], n).tolist()]
                    raw.append(b"".join(low[f + u : f + v].tobytes() for u, v in got))
                    sizes.append([v - u for u, v in got])
                yield pa.RecordBatch.from_arrays([chain, side_, b.column(1).take(pa.array(row)), other, lo, hi, solid, pa.array(raw, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], names=names)

    # by a shuffle, however small: the workers of the filter and of fetch() would live side by side in every task
    out = texts.join(asks.hint("merge"), "doc_id").select("text", "doc_id", "asks")
    return out.mapInArrow(fetch, "chain long, side int, doc_id long, other long, lo int, hi int, solid int, words binary, sizes array<int>")


def _read(raw: bytes, sizes: list[int]) -> list[np.ndarray]:
    """Words of 24 bits, in pieces of these sizes."""
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return np.split(wide.view("<i4").ravel(), np.cumsum(sizes)[:-1])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Seeds that a sample of at most about SAMPLE documents shows to have more than HOT places; they are dealt apart,
    nothing else depends on the sample."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("seeds")), F.lit(1 << 30)) < int(share * (1 << 30)))
    often = seeds(some).groupBy("seed").count().where(F.col("count") > max(1 if share == 1 else 8, int(HOT * share)))
    return np.sort(np.array([r[0] for r in often.orderBy(F.desc("count"), "seed").limit(HOT_SEEDS).select("seed").collect()], np.int64))


def _anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, place, owner_place): every seed's place and one in the document before that holds the seed."""
    hot, cuts = _frequent(docs), []
    if len(hot):
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / SPREAD for i in range(1, SPREAD)], 2000)).first()[0] or []))
    same = Window.partitionBy("seed", "part")
    before = same.orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    level = Window.partitionBy("seed", "part", "nth").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    held = seeds(docs, hot, cuts).withColumns({"low": F.min("doc_id").over(same), "high": F.max("doc_id").over(same)}).where("low < high or part > 0").drop("low", "high")
    # the same place in number of the document before, or its first
    held = held.withColumn("any", F.max(F.struct("doc_id", -F.col("nth"), "place")).over(before)).withColumn("own", F.max(F.struct("doc_id", "place")).over(level))
    at = F.when(F.col("own").isNull(), F.struct(F.col("any.doc_id").alias("owner"), F.col("any.place").alias("owner_place"))).otherwise(F.struct(F.col("own.doc_id").alias("owner"), F.col("own.place").alias("owner_place")))
    cold = F.when(F.col("part") > 0, F.col("seed")).alias("seed")
    held = common.cut(held.select("doc_id", "place", "nth", "part", cold, at.alias("at")).where("at.owner is not null or part > 0"), "anchors")
    out = held.where("at.owner is not null").select("doc_id", "at.owner", "place", "at.owner_place")
    if not len(hot):
        return out
    # a range's first document follows the last one of the ranges before: at the same place in number, or its first
    rows, by_part = held.where("part > 0"), lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.groupBy("seed", "part", "nth").agg(F.max(F.struct("doc_id", "place")).alias("own"))
    own = common.cut(own.withColumn("own", F.max("own").over(by_part("seed", "nth"))), "ends")
    any_ = rows.groupBy("seed", "part").agg(F.max(F.struct("doc_id", -F.col("nth"), "place")).alias("any"))
    any_ = common.cut(any_.withColumn("any", F.max("any").over(by_part("seed"))), "ends")
    far = rows.where("at.owner is null").drop("at").join(own, ["seed", "part", "nth"]).join(any_, ["seed", "part"])
    return out.union(far.select("doc_id", at.alias("at"), "place").where("at.owner is not null").select("doc_id", "at.owner", "place", "at.owner_place"))


def aligned_chains(documents: DataFrame) -> DataFrame:
    """(doc_id, owner, begin, end, matched): places of words in doc_id that an alignment finds in the owner."""
    docs = common.one_column(documents, "doc_id", "text").withColumn("text", F.col("text").cast("string")).where("doc_id is not null and text is not null")
    chained = common.cut(_chained(_anchors(docs)), "chains")
    sides = _fetched(chained, docs)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Both sides of every chain, in lists of about a thousand."""
        out, sides_, last = [], ([], []), None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != last:
                    out += [(x, y) for x in sides_[0] for y in sides_[1]]
                    sides_, last = ([], []), r[0]
                    if len(out) >= 1000:
                        yield out
                        out = []
                sides_[r[1]].append(r)
        yield out + [(x, y) for x in sides_[0] for y in sides_[1]]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in pairs(batches):
            p0, p1 = ([_read(p[s][7], p[s][8]) for p in both] for s in (0, 1))
            left = grow_many([p[0][::-1] for p in p0], [p[0][::-1] for p in p1])
            right = grow_many([p[1] for p in p0], [p[1] for p in p1])
            get = lambda i: np.array([p[0][i] for p in both], np.int64)
            inner = np.array([sum(matches(x, y) for x, y in zip(u[2:], v[2:])) for u, v in zip(p0, p1)], np.int64)
            words.give_back()
            cols = get(2), get(3), get(4) - left[:, 0], get(5) + right[:, 0], get(6) + left[:, 2] + right[:, 2] + inner
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "owner", "begin", "end", "matched"])

    sorted_ = sides.repartition(common.partitions(sides), "chain").sortWithinPartitions("chain", "side")
    out = sorted_.mapInArrow(align, "doc_id long, owner long, begin int, end int, matched int")
    return out.where(f"end - begin >= {PART} and matched >= 0.6 * (end - begin)")


def passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, begin_word, end_word, earlier_doc_id, n_words, matched_words): repeated passages, one row each.

    earlier_doc_id holds the longest part: of all documents with a part's seeds it is the last one before doc_id, not the
    first of all. Of parts of one length the smaller id counts.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, ["doc_id"]):
            out: list[list] = []
            for o, lo, hi, m in zip(*(t[c].to_pylist() for c in ("owner", "begin", "end", "matched"))):
                if out and lo <= out[-1][1] + JOIN:
                    p = out[-1]
                    new = max(0, hi - max(p[1], lo))
                    p[4] += m * new // (hi - lo)
                    p[1] = max(p[1], hi)
                    p[2], p[3] = max((p[3], -p[2]), (hi - lo, -o))[::-1]
                    p[2] = -p[2]
                else:
                    out.append([lo, hi, o, hi - lo, m])
            out = [p for p in out if p[1] - p[0] >= least]
            if out:
                col = lambda i: pa.array([p[i] for p in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([t["doc_id"][0].as_py()] * len(out), pa.int64()), col(0), col(1), col(2), pa.array([p[1] - p[0] for p in out], pa.int64()), col(4)], names=["doc_id", "begin_word", "end_word", "earlier_doc_id", "n_words", "matched_words"])

    parts = aligned_chains(documents)
    parts = parts.repartition(common.partitions(documents), "doc_id").sortWithinPartitions("doc_id", "begin", "end", "owner", "matched")
    return parts.mapInArrow(join, "doc_id long, begin_word long, end_word long, earlier_doc_id long, n_words long, matched_words long")


def without_passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Documents without their repeated passages; every passage stays in its first document.

    Documents without any stay as they are; those of which no word is left go. n_chars, if there, is set anew.
    """
    found = common.cut(passages(documents, least), "passages")
    key, other = common.fresh(documents.columns, "passage_key"), common.fresh(documents.columns, "passage_doc_id")
    spans = found.groupBy(F.col("doc_id").alias(other)).agg(F.collect_set(F.struct("begin_word", "end_word")).alias(common.fresh(documents.columns, "spans")))
    sent = common.id_filter(found.select("doc_id"))
    keyed = documents.withColumn(key, documents["doc_id"].cast("long"))
    clean = common.passing(keyed, key, sent, inside=False)
    # by a shuffle, however few spans: the workers of the filter and of cut() would live side by side in every task
    maybe = common.passing(keyed, key, sent).join(spans.hint("merge"), F.col(key) == F.col(other), "left").drop(other)
    text, chars = documents.columns.index("text"), documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.pieces(batch, batch.schema.names[text]):
                data, offsets = words.bytes_of(b.column(text))
                begins, ends, first = words.spans(data, offsets, words.LETTER_WORDS)
                raw = data.tobytes()
                texts, keep = b.column(text).to_pylist(), np.ones(b.num_rows, bool)
                sizes = b.column(chars).to_pylist() if chars is not None else None
                for i, s in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    if not s:
                        continue
                    f, n = int(first[i]), int(first[i + 1] - first[i])
                    left, at, some = [], int(offsets[i]), 0
                    last = 0
                    for lo, hi in sorted((x["begin_word"], min(x["end_word"], n)) for x in s):
                        if lo >= hi:
                            continue
                        left.append(raw[at : int(begins[f + lo])])
                        at = int(ends[f + hi - 1])
                        some += max(0, lo - last)
                        last = max(last, hi)
                    left.append(raw[at : int(offsets[i + 1])])
                    keep[i] = some + n - last > 0
                    texts[i] = b" ".join(left).decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                cols = list(b.columns[:-1])
                cols[text] = pa.array(texts, b.schema.field(text).type)
                if sizes is not None:
                    cols[chars] = pa.array(sizes, b.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(keep))

    return clean.unionByName(maybe.mapInArrow(cut, keyed.schema)).select(documents.columns)


def op5_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
