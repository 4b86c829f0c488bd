"""Spelling variants: words that differ by one edit, grouped under the most frequent form.

Words are counted with numpy over whole batches and summed by Spark. Near pairs come from sorted lists: a word of the
sorted vocabulary is compared with all that follow it, and the rows of the edit matrix (three cells each, as only one
edit counts) are reused: adjacent words with a common prefix share the rows of this prefix, so a range of the list with one prefix is
advanced at once, and is skipped when no cell of its row is at most one. Queries of a whole batch advance together, one
depth after the other.

The vocabulary is dealt to lists by all but a window of WINDOW code points: with a window where the two words first
differ, near words agree in what is before and, counted from the end, behind it. So each pair stands in one list, and a list
of words of up to 2 * WINDOWS code points can't have more than A^2 + A^3 words, A being the letters' number, whatever the
vocabulary. Longer words have WINDOWS wider windows. A list is scanned by one task.

Null texts have no words; a null doc_id counts as the empty string in the checksum. Rows that share a doc_id, or repeat, count each
occurrence. Other columns are not looked at. An empty table gives an empty result. Words of any length are handled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import BYTE_VALUES, bytes_of, hashes, pieces

SHORTEST = 5
FEWEST = 3
ALTERED = 97
WINDOW = 2
WINDOWS = 32
#: rows of lists scanned at once, and queries that advance together
SCANNED = 1 << 16
TOGETHER = 1 << 13


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF; all of its followers are letters here


def crcs(low: np.ndarray, begins: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """CRC-32 of low[begin:end] for every word, going on from the CRC-32 in start."""
    size = ends - begins
    order = np.argsort(-size, kind="stable")
    at, left = begins[order], size[order]
    reg = start[order] ^ np.uint32(0xFFFFFFFF)
    most = 64
    for p in range(min(most, int(left[0])) if len(left) else 0):
        k = int(np.searchsorted(-left, -p, "left"))  # words longer than p
        reg[:k] = _CRC[(reg[:k] ^ low[at[:k] + p]) & np.uint32(255)] ^ (reg[:k] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > most).tolist():
        out[i] = zlib.crc32(low[begins[i] : ends[i]].tobytes(), int(start[i]))
    return out


def counted(ids: list, texts: pa.Array, totals: dict[bytes, int]) -> None:
    """Adds the words of the texts, altered where the checksum says so, to totals."""
    data, offsets = bytes_of(texts)
    if not len(data):
        return
    lead = data == _LEAD
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([False], letter[:-1])), np.concatenate((letter[1:], [False]))
    begins = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    wide = np.concatenate(([0], np.cumsum(lead)))
    points = ends - begins - (wide[ends] - wide[begins])
    low = BYTE_VALUES[data]
    of = np.searchsorted(offsets, begins, "right") - 1
    start = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32)
    # a word of SHORTEST - 1 code points and fewer never counts, whether or not one goes
    enough = points >= SHORTEST
    begins, ends, points, of = begins[enough], ends[enough], points[enough], of[enough]
    if not len(begins):
        return
    crc = crcs(low, begins, ends, start[of])
    hit = crc % ALTERED == 0
    for i in np.flatnonzero(hit & (points > SHORTEST)).tolist():
        w = low[begins[i] : ends[i]].tobytes().decode()
        k = int(crc[i]) % len(w)
        totals[(w[:k] + w[k + 1 :]).encode()] += 1
    begins, ends = begins[~hit], ends[~hit]
    _, first, count = np.unique(hashes(data, begins, ends), return_index=True, return_counts=True)
    for b, e, c in zip(begins[first].tolist(), ends[first].tolist(), count.tolist()):
        totals[low[b:e].tobytes()] += c


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least SHORTEST code points that occur FEWEST times or more."""
    d = common.one_column(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = defaultdict(int)

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()).cast(pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
            totals.clear()
            return out

        for b in batches:
            for p in pieces(b, "text", 1 << 20):
                counted(p.column(0).to_pylist(), p.column(1), totals)
                if len(totals) > 1 << 17:
                    yield send()
        if totals:
            yield send()

    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


def _window(shorter):
    """Width of the windows of words whose shorter one has so many code points; for columns and numbers."""
    return F.greatest(F.lit(WINDOW), F.ceil(shorter / WINDOWS).cast("int"))


def lists(vocab: DataFrame) -> DataFrame:
    """(list, word, n, part): every word once for each window of its own length, and of one less, for pairs whose shorter word
    has that length. part holds the length and the window's number."""
    size = F.length("word")
    w = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("shorter")).where(F.col("shorter") >= SHORTEST)
    w = w.withColumn("width", _window(F.col("shorter")))
    w = w.withColumn("nth", F.explode(F.sequence(F.lit(0), F.ceil(F.col("shorter") / F.col("width")).cast("int") - 1)))
    head = F.expr("substring(word, 1, nth * width)")
    tail = F.expr("right(word, shorter - least(shorter, (nth + 1) * width))")
    return w.select(F.xxhash64("shorter", "nth", head, tail).alias("list"), "word", "n", (F.col("shorter") * 64 + F.col("nth")).alias("part"))


def latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row (all are under 256), and where each word begins."""
    data, offsets = bytes_of(words)
    if not len(data):
        return data, offsets
    lead = data == _LEAD
    follows = np.concatenate(([False], lead[:-1]))
    return np.where(follows, data + 0x40, data).astype(np.uint8)[~lead], offsets - np.concatenate(([0], np.cumsum(lead)))[offsets]


def prefixes(flat: np.ndarray, off: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Longest common prefix of every word with the one before it; -1 at the beginning of a list."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.full(n, -1, np.int64)
    at = np.setdiff1d(np.arange(n), begins, assume_unique=True)
    least = np.minimum(size[at], size[at - 1])
    d = 0
    while len(at):
        more = least > d
        out[at[~more]] = d
        at, least = at[more], least[more]
        same = flat[off[at] + d] == flat[off[at - 1] + d]
        out[at[~same]] = d
        at, least = at[same], least[same]
        d += 1
    return out


def scan(flat: np.ndarray, off: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in sorted lists, pairs (a, b) of one list that differ by exactly one edit, a before b, and where they first differ."""
    n = len(off) - 1
    size = np.diff(off)
    lcp = prefixes(flat, off, begins)
    end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    inner = np.where(lcp < 0, np.iinfo(np.int64).max, lcp)
    common_ = np.repeat(np.minimum.reduceat(inner, begins), np.diff(np.append(begins, n))) if n else inner
    asks = np.flatnonzero(np.arange(n) + 1 < end)
    padded = np.append(flat, np.zeros(2, np.uint8))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(0, len(asks), TOGETHER):
        some = asks[k : k + TOGETHER]
        some = some[np.argsort(common_[some], kind="stable")]
        begin = common_[some]
        q = lo = hi = first = np.zeros(0, np.int64)
        r0 = r1 = r2 = np.zeros(0, np.uint8)
        d, taken = int(begin[0]), 0
        while len(q) or taken < len(some):
            if not len(q):
                d = int(begin[taken])
            upto = int(np.searchsorted(begin, d, "right"))
            new = some[taken:upto]
            taken = upto
            if len(new):  # all words of these lists agree up to here
                m = len(new)
                q, lo, hi, first = np.append(q, new), np.append(lo, new + 1), np.append(hi, end[new]), np.append(first, np.full(m, -1))
                r0, r1, r2 = np.append(r0, np.full(m, 1 if d else 2, np.uint8)), np.append(r1, np.zeros(m, np.uint8)), np.append(r2, np.ones(m, np.uint8))
            # words that end here are first in their range
            over = size[lo] == d
            if over.any():
                i = np.flatnonzero(over)
                j = size[q[i]] - d
                cell = np.where(j == 0, r1[i], np.where(j == 1, r2[i], np.where(j == -1, r0[i], 2)))
                hit = i[cell == 1]
                found.append((q[hit], lo[hit], np.where(first[hit] < 0, d, first[hit])))
                lo = lo + over
                q, lo, hi, first, r0, r1, r2 = (x[lo < hi] for x in (q, lo, hi, first, r0, r1, r2))
            if not len(q):
                d += 1
                continue
            # ranges that go on with one code point each
            cuts = np.flatnonzero(lcp <= d)
            k0, k1 = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "left")
            count = k1 - k0 + 1
            of = np.repeat(np.arange(len(q)), count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            # cuts has no entry before a range's first or behind its last child
            clo = np.where(nth == 0, lo[of], cuts[np.minimum(k0[of] + nth - 1, len(cuts) - 1)])
            chi = np.where(nth == count[of] - 1, hi[of], cuts[np.minimum(k0[of] + nth, len(cuts) - 1)])
            c = flat[off[clo] + d]
            q, first = q[of], first[of]
            left = size[q] - d
            base = off[q] + d
            apart = padded[base] != c
            apart |= left < 1
            n0 = np.minimum(r0[of] + (padded[np.maximum(base - 1, 0)] != c), r1[of] + 1)
            n0[left < 0] = 2
            n1 = np.minimum(np.minimum(r1[of] + apart, r2[of] + 1), n0 + 1)
            n1[left < 1] = 2
            n2 = np.minimum(r2[of] + (padded[np.minimum(base + 1, len(padded) - 1)] != c), n1 + 1)
            n2[left < 2] = 2
            keep = np.minimum(np.minimum(n0, n1), n2) <= 1
            first = np.where((first < 0) & apart, d, first)
            q, lo, hi, first, r0, r1, r2 = (x[keep] for x in (q, clo, chi, first, n0.astype(np.uint8), n1.astype(np.uint8), n2.astype(np.uint8)))
            d += 1
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    a, b, at = (np.concatenate(x) for x in zip(*found))
    return a, b, at


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, other, n): every ordered pair of near words, with the occurrences of other."""
    parts = common.partitions(vocab)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of whole lists, some SCANNED at a time."""
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            if size >= SCANNED:
                names = b.column(0).to_numpy()
                change = np.flatnonzero(names != held[-1].column(0)[-1].as_py())
                if len(change):
                    held.append(b.slice(0, change[0]))
                    yield pa.Table.from_batches(held)
                    held, size, b = [], 0, b.slice(change[0])
            held.append(b)
            size += b.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches):
            names = t["list"].to_numpy()
            new = np.concatenate(([True], names[1:] != names[:-1]))
            alone = new & np.concatenate((new[1:], [True]))
            t, new = t.filter(pa.array(~alone)), new[~alone]
            if not t.num_rows:
                continue
            words = t["word"].combine_chunks()
            flat, off = latin(words)
            a, b, at = scan(flat, off, np.flatnonzero(new))
            part, n, size = t["part"].to_numpy(), t["n"].to_numpy(), np.diff(off)
            # a pair counts in the list of the window where its words first differ
            shorter = np.minimum(size[a], size[b])
            width = np.maximum(WINDOW, -(-shorter // WINDOWS))
            mine = shorter * 64 + np.minimum(at // width, -(-shorter // width) - 1)
            ok = (part[a] == mine) & (part[b] == mine)
            a, b = np.concatenate((a[ok], b[ok])), np.concatenate((b[ok], a[ok]))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(n[b])], names=["word", "other", "n"])

    rows = lists(vocab).repartition(parts, "list").sortWithinPartitions("list", "word")
    return rows.mapInArrow(run, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms ends. Forms at least double n, so pointers double up in few rounds."""
    now = common.cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = common.cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        common.drop(now)
        now = new.select("word", "root")
        now._cut_path = new._cut_path
        if not new.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocab = common.cut(vocabulary(docs), "vocabulary")
    near = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    known = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("best"))
    known = common.cut(known.select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")), "near")
    common.drop(vocab)
    found = roots(known.where("form is not null"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
