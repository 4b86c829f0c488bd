"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

Texts are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII. The automaton holds
all runs of words of all items; a document's words are streamed through it, which tracks the longest run that ends at
each word. A window is any `window` consecutive words of an item; an item of fewer words is one window as a whole.
Words inside an occurrence of a window are hit. Only stretches of a document whose q-grams all occur in items are
streamed; every window lies inside one.

A benchmark of at most SHARD_WORDS words is one automaton, broadcast to all tasks. A larger one stays distributed: a
filter of fixed size over its q-grams picks the stretches of documents in one pass, and only these are sent to shards of
about SHARD_WORDS words of items, where a task builds the shard's automaton. Longer items are cut into runs that overlap
by a window less a word. The plan and what is broadcast are the same for any benchmark.

Null text has no words; an item without words or with a null id never matches; items with the same id count once.
Documents with null or repeated doc_id are rows like others. Texts of any length are read whole; other columns pass
unchanged, and a column named like the result is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

SHARD_WORDS = 200_000
TABLE_LOG2 = 20
FILTER_LOG2 = 23
#: tasks that share a shard's stretches
SALTS = 16


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, c, q: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        new = len(self.link) - 1
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            new, p = len(self.link) - 1, last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            last = new

    def stream(self, sequence) -> Iterator[tuple[int, int]]:
        """For each symbol the state and length of the longest run that ends there."""
        v = n = 0
        for c in sequence:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            q = self.next[v].get(c)
            v, n = (0, 0) if q is None else (q, n + 1)
            yield v, n

    def holding(self, v: int, n: int) -> int:
        """The state of the suffix of length n of a run at v."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v


def _stretches(at: np.ndarray, first: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """Begin and end of runs of at least `least` words covered by the q-grams at these places, each within one text."""
    text = np.searchsorted(first, at, "right") - 1
    ok = at + q <= first[np.minimum(text + 1, len(first) - 1)]
    at, text = at[ok], text[ok]
    if not len(at):
        return []
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(text) != 0)))
    begin, end = at[new], at[np.concatenate((new[1:], [True]))] + q
    ok = end - begin >= least
    return list(zip(begin[ok].tolist(), end[ok].tolist()))


class Matcher:
    """Occurrences of the items' windows in word sequences."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window, self.automaton = window, SuffixAutomaton()
        items = [(k, w) for k, w in items if len(w)]
        for _, w in items:
            self.automaton.add(w.tolist())
        a = self.automaton
        self.long: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for k, w in items:
            if len(w) >= window:
                for v, n in a.stream(w.tolist()):
                    if n >= window:
                        self.long.setdefault(a.holding(v, window), set()).add(k)
            else:
                *_, (v, n) = a.stream(w.tolist())
                self.short.setdefault(a.holding(v, len(w)), []).append((len(w), k))
        self.least = min([window, *(len(w) for _, w in items)]) if items else 0
        self.q = min(self.least, 4)
        grams = [words.runs(w, self.q) for _, w in items if len(w) >= self.q]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << TABLE_LOG2, bool)
        self.table[(self.grams >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)] = True

    def stretches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of all stretches of words in which a window may occur, each within one text."""
        if not len(self.grams) or len(h) < self.q:
            return []
        r = words.runs(h, self.q)
        at = np.flatnonzero(self.table[(r >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)])
        x = np.searchsorted(self.grams, r[at])
        at = at[self.grams[np.minimum(x, len(self.grams) - 1)] == r[at]]
        return _stretches(at, first, self.q, self.least)

    def find(self, h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words in h, and the items that occur."""
        spans, items, a = [], set(), self.automaton
        for i, (v, n) in enumerate(a.stream(h.tolist())):
            if n >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items |= self.long.get(a.holding(v, self.window), set())
            while v and self.short:
                for size, k in self.short.get(v, ()):
                    if size <= n:
                        spans.append((i + 1 - size, i + 1))
                        items.add(k)
                v = a.link[v]
        return spans, items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


HITS = "n_words long, spans array<struct<begin:int,end:int>>, chars array<struct<begin:int,end:int>>, items array<string>"
_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _told(offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, found: dict[int, tuple]) -> pa.Array:
    """The struct HITS of every text; found has spans and items of those that have any."""
    rows = []
    for d in range(len(offsets) - 1):
        s, x = found.get(d, ((), ()))
        s = _joined(s)
        f, o = int(first[d]), int(offsets[d])
        rows.append({"n_words": int(first[d + 1]) - f, "spans": [{"begin": a, "end": b} for a, b in s], "chars": [{"begin": int(begins[f + a]) - o, "end": int(ends[f + b - 1]) - o} for a, b in s], "items": sorted(x)})
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", _SPAN), ("chars", _SPAN), ("items", pa.list_(pa.string()))]))


def _routed(documents: DataFrame, items: DataFrame, total: int, window: int) -> tuple[DataFrame, DataFrame, str]:
    """Documents with a row id (a table), (row id, spans, items) of those with occurrences, and the row id's name."""
    spark, parts = documents.sparkSession, common.partitions(documents)
    rid = common.fresh(documents.columns, "row_id")
    docs = common.cut(documents.withColumn(rid, F.monotonically_increasing_id()), "rows")
    n = -(-total // SHARD_WORDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = words.word_hashes(pa.array([t]), words.LETTER_WORDS)[0]
                if len(h):
                    starts = range(0, len(h) - window + 1, SHARD_WORDS) if len(h) > SHARD_WORDS + window else [0]
                    rows += [(k, i, h[i : i + SHARD_WORDS + window - 1] if len(starts) > 1 else h) for i in starts]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["k", "begin", "size", "words"])

    runs = common.cut(items.mapInArrow(cut, "k string, begin long, size int, words binary"), "items")
    shortest = runs.agg(F.min("size")).first()[0]
    least = min(window, shortest or window)
    q = min(least, 4)

    def fold(b: pa.RecordBatch, sums: np.ndarray) -> None:
        for raw in b.column(0).to_pylist():
            sums[(words.runs(np.frombuffer(raw, np.uint64), q) >> np.uint64(64 - FILTER_LOG2)).astype(np.int64)] = 1

    sent = spark.sparkContext.broadcast(np.packbits(common.sketch_sum(runs.select("words"), fold, 1 << FILTER_LOG2, kind=np.uint8) > 0))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            for part in words.pieces(batch, "text"):
                h, first = words.word_hashes(part.column(1), words.LETTER_WORDS)
                at = np.flatnonzero(bits[(words.runs(h, q) >> np.uint64(64 - FILTER_LOG2)).astype(np.int64)])
                found = _stretches(at, first, q, least)
                d = np.searchsorted(first, [lo for lo, _ in found], "right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d, pa.int64())), pa.array([lo - int(first[i]) for (lo, _), i in zip(found, d)], pa.int64()), pa.array([h[lo:hi].tobytes() for lo, hi in found], pa.binary())], names=["row", "begin", "words"])

    text = docs.select(F.col(rid), F.col("text").cast("string").alias("text"))
    stretches = text.mapInArrow(pick, "row long, begin long, words binary")
    asked = stretches.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.pmod(F.xxhash64("row", "begin"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("role"), F.lit(None).cast("string").alias("k"), "row", "begin", "words")
    held = runs.select(F.pmod(F.xxhash64("k", "begin"), F.lit(n)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("role"), "k", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("begin"), "words")
    both = held.union(asked).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "role")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, m = None, [], None  # one shard's automaton at a time
        for b in batches:
            out: list[tuple] = []
            for shard, salt, role, k, row, begin, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (shard, salt) != key:
                    key, mine, m = (shard, salt), [], None
                h = np.frombuffer(raw, np.uint64)
                if not role:
                    mine.append((k, h))
                    continue
                m = m or Matcher(mine, window)
                for lo, hi in m.stretches(h, np.array([0, len(h)])):
                    spans, some = m.find(h[lo:hi])
                    if spans:
                        out.append((row, [{"begin": begin + lo + x, "end": begin + lo + y} for x, y in _joined(spans)], sorted(some)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], _SPAN), pa.array([r[2] for r in out], pa.list_(pa.string()))], names=["row", "spans", "items"])

    found = both.mapInArrow(find, "row long, spans array<struct<begin:int,end:int>>, items array<string>")
    return docs, common.cut(found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits"), rid


def match(documents: DataFrame, benchmark: DataFrame, window: int = 10, into: str = "match") -> DataFrame:
    """All columns of documents, and `into` struct<n_words, spans (of words), chars (the same in bytes), items>."""
    if common.fresh(documents.columns, into) != into:
        raise ValueError(f"documents have a column {into}")
    spark, text = documents.sparkSession, documents.columns.index("text")
    common.small_batches(spark)
    fields = [f"`{n}` {t}" for n, t in documents.dtypes]
    schema = ", ".join([*fields, f"`{into}` struct<{','.join(x.replace(' ', ':', 1) for x in HITS.split(', '))}>"])
    items = benchmark.select(benchmark["item_id"].cast("string").alias("k"), benchmark["text"].cast("string").alias("t")).where("k is not null and t is not null").distinct()
    # a word has two characters with its space at least
    total = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // 2)
    if total > SHARD_WORDS:
        docs, hits, rid = _routed(documents, items, total, window)
        sent = common.id_filter(hits.select("row"))
        spans, some = (common.fresh(docs.columns, c) for c in ("spans", "items"))
        clean = common.passing(docs, rid, sent, inside=False).select("*", F.lit(None).cast("array<struct<begin:int,end:int>>").alias(spans), F.lit(None).cast("array<string>").alias(some))
        maybe = common.passing(docs, rid, sent).join(hits.select(F.col("row").alias(rid), F.col("spans").alias(spans), F.col("items").alias(some)), rid, "left").select(clean.columns)

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in words.pieces(batch, batch.schema.names[text]):
                    data, offsets = words.bytes_of(part.column(text))
                    begins, ends, first = words.spans(data, offsets, words.LETTER_WORDS)
                    found = {d: ([(x["begin"], x["end"]) for x in s], i) for d, (s, i) in enumerate(zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())) if s}
                    yield pa.RecordBatch.from_arrays([*part.columns[:-3], _told(offsets, begins, ends, first, found)], names=[*part.schema.names[:-3], into])

        return clean.union(maybe).mapInArrow(tell, schema)
    # at most SHARD_WORDS words
    sent = spark.sparkContext.broadcast(Matcher([(k, words.word_hashes(pa.array([t]), words.LETTER_WORDS)[0]) for k, t in items.collect()], window))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in words.pieces(batch, batch.schema.names[text]):
                data, offsets = words.bytes_of(part.column(text))
                begins, ends, first = words.spans(data, offsets, words.LETTER_WORDS)
                h = words.hashes(data, begins, ends)
                found: dict[int, tuple[list, set]] = {}
                for lo, hi in m.stretches(h, first):
                    spans, some = m.find(h[lo:hi])
                    if spans:
                        d = int(np.searchsorted(first, lo, "right") - 1)
                        s, x = found.setdefault(d, ([], set()))
                        s += [(lo + a - int(first[d]), lo + b - int(first[d])) for a, b in spans]
                        x |= some
                yield pa.RecordBatch.from_arrays([*part.columns, _told(offsets, begins, ends, first, found)], names=[*part.schema.names, into])

    return documents.mapInArrow(hits, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents without the hit spans; those with more than max_coverage of their words hit go as a whole.

    Clean documents stay as they are. n_chars, if there, is set anew where text is cut.
    """
    into = common.fresh(documents.columns, "match")
    m = match(documents, benchmark, window, into)
    found = F.col(into)
    hit = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    m = m.where(hit <= F.lit(max_coverage) * found["n_words"])
    raw = F.encode(F.col("text"), "utf-8")
    # what lies between the spans
    begins = F.concat(F.array(F.lit(0)), found["chars"]["end"])
    ends = F.concat(found["chars"]["begin"], F.array(F.octet_length("text")))
    parts = F.zip_with(begins, ends, lambda b, e: F.decode(F.substring(raw, b + 1, e - b), "utf-8"))
    cut = F.size(found["spans"]) > 0
    out = m.withColumn("text", F.when(cut, F.array_join(parts, " ")).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(documents.columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.one_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    m = match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("match.spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return m.select("doc_id", F.col("match.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("match.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("match.items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP1_SQL = r"""
with dw as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) w from documents
), iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null
), win as (
  select distinct item_id, case when len(w) >= 10 then w[p:p + 9] else w end g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from iw where len(w) > 0)
), sizes as (select distinct len(g) l from win
), grams as (
  select doc_id, l, p, w[p:p + l - 1] g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) p from dw, sizes where len(w) >= l)
), found as (select doc_id, p, l, item_id from grams join win using (g)
), hit as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(p, p + l)) x from found) group by 1
), items as (
  select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct doc_id, cast(item_id as varchar) i from found) group by 1
)
select dw.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
"""
