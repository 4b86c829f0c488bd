"""Exact copies by a cuckoo-filter index of live digests.

A document's key is the SHA-256 of its text without white space. The first bits of the key name its shard, 64 of its
bits stand for it in the shard's cuckoo filter: buckets of four 16-bit fingerprints, each at one of two places. An index
has two tables in the shared folder: the content (one row per live document, with key and shard), and one filter per shard.

* insert(): keys are combined within tasks, so that a group of any size sends a few, and stream through their shards'
  filters. A key that the filter does not know is new for sure and enters. A hit is verified: against the keys that
  the shard has stored in this run, or by a join with the content of earlier runs. False hits enter, too.
* delete(): documents leave the content; keys of which no document is left leave the filters.
* overflow: a filter that cannot place a key is built anew with twice the buckets from its stored keys: those of the run, or
  the shard's content where an earlier run stored them.
* copies(): only keys that were verified as repeated are grouped, by all 256 bits; all others are single.

Null text counts as empty. Of equal texts the row with the most code points in the original text stays, then the smallest doc_id (null
last), then one of rows that agree in both. Rows may share a doc_id; delete() removes all rows of an id. Extra columns are not
looked at. An empty table gives an empty index and an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mix

SLOTS = 4
#: moves of fingerprints until a filter counts as full
KICKS = 500
#: rows to a shard, for which the number of shards is chosen when an index is made
SHARD_ROWS = 1 << 19
#: keys that a task combines before it sends them
COMBINED = 1 << 18
WHITE = " \t\n\x0b\x0c\r"


class Cuckoo:
    """A cuckoo filter over 64-bit keys, worked on in whole arrays. Keys must be distinct when they are inserted."""

    def __init__(self, log2: int = 6, table: np.ndarray | None = None):
        self.log2 = log2
        self.table = np.zeros((1 << log2, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray, log2: int = 6) -> Cuckoo:
        """A filter that holds the keys, as small as a load of 7/8 allows, or larger if they do not fit."""
        while len(keys) > (SLOTS << log2) * 7 // 8:
            log2 += 1
        while True:
            f = cls(log2)
            if not len(f.insert(keys)):
                return f
            log2 += 1

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, and both buckets; the second follows from the first and the fingerprint alone."""
        k = keys.view(np.uint64)
        tag = (k >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        one = (mix(k) & np.uint64((1 << self.log2) - 1)).astype(np.int64)
        return tag, one, self.other(one, tag)

    def other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(tag.astype(np.uint64)) & np.uint64((1 << self.log2) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, one, two = self.places(keys)
        return (self.table[one] == tag[:, None]).any(1) | (self.table[two] == tag[:, None]).any(1)

    def _put(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Places one tag for each bucket with a free slot; tells which were placed."""
        order = np.argsort(bucket, kind="stable")
        first = order[np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))] if len(order) else order
        free = self.table[bucket[first]] == 0
        ok = free.any(1)
        first, free = first[ok], free[ok]
        self.table[bucket[first], free.argmax(1)] = tag[first]
        done = np.zeros(len(bucket), bool)
        done[first] = True
        return done

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Inserts keys; returns the tags of what found no place (nothing, as a rule). A filter with a rest is full: it lacks keys."""
        tag, one, two = self.places(keys)
        for k in range(2 * SLOTS):
            left = ~self._put(two if k % 2 else one, tag)
            tag, one, two = tag[left], one[left], two[left]
            if not len(tag):
                return tag
        at = one
        for k in range(KICKS):
            # one tag of every full bucket gives way and goes to its other bucket
            order = np.argsort(at, kind="stable")
            first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))]
            slot = (at[first] * 7 + k) % SLOTS
            out = self.table[at[first], slot]
            self.table[at[first], slot] = tag[first]
            tag[first] = out
            moved = self.other(at[first], out)
            at[first] = np.where(out > 0, moved, at[first])
            left = tag > 0
            tag, at = tag[left], at[left]
            done = self._put(at, tag) if len(tag) else np.zeros(0, bool)
            tag, at = tag[~done], at[~done]
            if not len(tag):
                break
        return tag

    def delete(self, keys: np.ndarray) -> None:
        """Removes one fingerprint of each key; keys must be in the filter."""
        while len(keys):
            tag, one, two = self.places(keys)
            here = (self.table[one] == tag[:, None]).any(1)
            bucket = np.where(here, one, two)
            _, first = np.unique(bucket, return_index=True)  # one at a time from a bucket
            hit = self.table[bucket[first]] == tag[first][:, None]
            ok = hit.any(1)
            self.table[bucket[first][ok], hit[ok].argmax(1)] = 0
            keys = np.delete(keys, first)


@dataclass(frozen=True)
class Index:
    """content: row, doc_id, n_chars, digest, key, shard of live documents. filters: shard, log2, tags. repeated: keys of more
    than one live document, as far as inserts have found them."""

    content: DataFrame
    filters: DataFrame
    repeated: DataFrame
    bits: int

    def drop(self) -> None:
        for t in (self.content, self.filters, self.repeated):
            common.drop(t)


def _bare(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def keyed(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, digest, key of every row; row numbers tell apart rows that agree in all else."""
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.length(text).alias("n_chars"), F.unhex(F.sha2(_bare(text), 256)).alias("digest"))
    return d.withColumn("key", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))


def _shard(bits: int) -> Column:
    """The shard is named by bits that neither the fingerprint nor the bucket is made of alone."""
    return F.shiftrightunsigned(F.xxhash64("digest"), 64 - bits).cast("int") if bits else F.lit(0)


def _combined(rows: DataFrame) -> DataFrame:
    """shard, key, many: the keys of a task, each once for COMBINED rows; many: it stood there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            both, count = np.unique(np.concatenate(held, 1), axis=1, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.int32)), pa.array(both[1]), pa.array(count > 1)], names=["shard", "key", "many"])

        size = 0
        for b in batches:
            held.append(np.stack((b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy())))
            size += b.num_rows
            if size >= COMBINED:
                yield send()
                size = 0
        if held:
            yield send()

    return rows.select("shard", "key").mapInArrow(run, "shard int, key long, many boolean")


_PASSED = "what string, shard int, key long, log2 int, tags binary"


def _through(filters: DataFrame | None, keys: DataFrame, work: str) -> DataFrame:
    """Streams keys (shard, key, many) through their shards' filters. work: insert, sure (insert without a question), delete or probe.

    Rows out, by `what`: filter (the shard's new state), new (entered), repeat (verified here), ask (a hit that content of
    earlier runs must verify), full (the filter must be built from the content).
    """
    parts = common.partitions(keys)
    rows = keys.select("shard", F.lit(1).alias("kind"), "key", "many", F.lit(None).cast("int").alias("log2"), F.lit(None).cast("binary").alias("tags"))
    if filters is not None:
        rows = rows.unionByName(filters.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("boolean").alias("many"), "log2", "tags"))

    def told(what: str, shard: int, keys_: np.ndarray, log2: int | None = None, tags: bytes | None = None) -> pa.RecordBatch:
        n = len(keys_) if tags is None else 1
        return pa.RecordBatch.from_arrays([pa.array([what] * n, pa.string()), pa.array([shard] * n, pa.int32()), pa.array(keys_ if tags is None else [None], pa.int64()), pa.array([log2] * n, pa.int32()), pa.array([tags] * n, pa.binary())], names=["what", "shard", "key", "log2", "tags"])

    class Shard:
        def __init__(self, name: int):
            self.name, self.filter, self.old, self.full = name, Cuckoo(), False, False
            self.stored = np.zeros(0, np.int64)  # keys that entered in this run, sorted

        def step(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if b.column(1)[0].as_py() == 0:
                self.old, log2 = True, b.column(4)[0].as_py()
                self.filter = Cuckoo(log2, np.frombuffer(b.column(5)[0].as_py(), np.uint16).reshape(-1, SLOTS).copy())
                b = b.slice(1)
                if not b.num_rows:
                    return
            arrived = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            if work == "delete":
                self.filter.delete(np.unique(arrived))
                return
            key, place, count = np.unique(arrived, return_index=True, return_counts=True)
            if work == "probe":
                yield told("ask", self.name, key[self.filter.contains(key)])
                return
            many = np.zeros(len(key), bool)
            many[np.searchsorted(key, arrived[b.column(3).to_numpy(zero_copy_only=False).astype(bool)])] = True
            many |= count > 1
            hit = self.filter.contains(key) if work == "insert" and not self.full else np.zeros(len(key), bool)
            if self.full:  # the filter is void: every key is asked about
                yield told("ask", self.name, key)
                return
            at = np.searchsorted(self.stored, key)
            mine = np.zeros(len(key), bool)
            mine[at < len(self.stored)] = self.stored[at[at < len(self.stored)]] == key[at < len(self.stored)]
            ask = hit & ~mine if self.old else np.zeros(len(key), bool)
            enters = ~ask & ~mine
            yield told("repeat", self.name, key[mine | (many & enters)])
            yield told("ask", self.name, key[ask])
            fresh = key[enters]
            yield told("new", self.name, fresh)
            self.stored = np.union1d(self.stored, fresh)
            if len(self.filter.insert(fresh)):
                if self.old:
                    self.full = True
                else:
                    self.filter = Cuckoo.of(self.stored, self.filter.log2 + 1)

        def end(self) -> Iterator[pa.RecordBatch]:
            if self.full:
                yield told("full", self.name, np.zeros(1, np.int64))
            elif work != "probe":
                yield told("filter", self.name, np.zeros(0, np.int64), self.filter.log2, self.filter.table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            names = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if now is None or now.name != int(names[lo]):
                    if now is not None:
                        yield from now.end()
                    now = Shard(int(names[lo]))
                yield from now.step(b.slice(lo, hi - lo))
        if now is not None:
            yield from now.end()

    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, _PASSED)


def _rebuilt(content: DataFrame, shards: DataFrame) -> DataFrame:
    """Filters of the shards from the keys that their content has."""
    stored = content.join(shards.select("shard").distinct(), "shard", "left_semi").select("shard", "key").distinct()
    return _through(None, stored.withColumn("many", F.lit(False)), "sure").where("what = 'filter'").select("shard", "log2", "tags")


def build(docs: DataFrame) -> Index:
    """An index of all rows of docs (doc_id, text)."""
    rows = common.cut(keyed(docs), "keyed")
    least = 4 * common.partitions(rows)
    bits = max(least, -(-rows.count() // SHARD_ROWS)).bit_length()
    content = rows.withColumn("shard", _shard(bits))
    passed = common.cut(_through(None, _combined(content), "insert"), "passed")
    repeated = common.cut(passed.where("what = 'repeat'").select("key").distinct(), "repeated")
    filters = common.cut(passed.where("what = 'filter'").select("shard", "log2", "tags"), "filters")
    common.drop(passed)
    content._cut_path = getattr(rows, "_cut_path", None)
    return Index(content, filters, repeated, bits)


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with the rows of docs added; the index given stays as it is."""
    last = index.content.agg(F.max("row")).first()[0]
    rows = common.cut(keyed(docs).withColumn("row", F.col("row") + F.lit(0 if last is None else last + 1)).withColumn("shard", _shard(index.bits)), "keyed")
    passed = common.cut(_through(index.filters, _combined(rows), "insert"), "passed")
    content = common.cut(index.content.unionByName(rows), "content")
    asked = passed.where("what = 'ask'").select("shard", "key").distinct()
    known = index.content.select("key").distinct()
    again = asked.join(known, "key", "left_semi").select("key")
    entered = passed.where("what = 'new'").select("key")
    false = common.cut(asked.join(known, "key", "left_anti").join(entered, "key", "left_anti").withColumn("many", F.lit(False)).select("shard", "key", "many"), "false")
    # hits that were false, or asked about after an overflow, may stand several times in the new rows
    twice = rows.join(false.select("key"), "key", "left_semi").groupBy("key").count().where("count > 1").select("key")
    repeated = common.cut(index.repeated.union(passed.where("what = 'repeat'").select("key")).union(again).union(twice).distinct(), "repeated")
    filters = passed.where("what = 'filter'").select("shard", "log2", "tags")
    filters = filters.unionByName(index.filters.join(passed.select("shard").distinct(), "shard", "left_anti"))
    filters = common.cut(filters, "filters")
    full = passed.where("what = 'full'").select("shard")
    after = _through(filters, false.join(full, "shard", "left_anti"), "sure")
    after = common.cut(after, "after")
    # filters that overflowed, now or in the second pass, are built from the content, which has all new keys
    full = common.cut(full.unionByName(after.where("what = 'full'").select("shard")).distinct(), "full")
    done = after.where("what = 'filter'").select("shard", "log2", "tags").unionByName(_rebuilt(content, full))
    out = Index(content, common.cut(done, "filters"), repeated, index.bits)
    for t in (rows, passed, false, filters, after, full):
        common.drop(t)
    return out


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without the rows of the given doc_ids; the index given stays as it is."""
    ids = ids.select(ids["doc_id"].cast("long").alias("doc_id")).distinct()
    content = common.cut(index.content.join(ids, "doc_id", "left_anti").select(index.content.columns), "content")
    gone = index.content.join(ids, "doc_id", "left_semi").select("shard", "key").distinct().join(content.select("key").distinct(), "key", "left_anti")
    passed = common.cut(_through(index.filters, gone.withColumn("many", F.lit(False)).select("shard", "key", "many"), "delete"), "passed")
    repeated = common.cut(index.repeated.join(content.select("key").distinct(), "key", "left_semi"), "repeated")
    return Index(content, passed.where("what = 'filter'").select("shard", "log2", "tags"), repeated, index.bits)


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """(doc_id, held): whether a live document has the text. Only hits of the filters are looked up in the content."""
    rows = common.cut(keyed(docs).withColumn("shard", _shard(index.bits)), "keyed")
    hits = _through(index.filters, _combined(rows), "probe").where("what = 'ask'").select("key").distinct()
    held = index.content.join(common.cut(hits, "hits"), "key", "left_semi").select("digest").distinct().withColumn("held", F.lit(True))
    return rows.join(held, "digest", "left").select("doc_id", F.coalesce("held", F.lit(False)).alias("held"))


def copies(index: Index) -> DataFrame:
    """One row per live document: doc_id, keep_id, group_size, kept, text_sha256."""
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("named"), F.bitwise_not("doc_id").alias("first"), F.bitwise_not("row").alias("row"), "doc_id"))
    groups = index.content.join(index.repeated, "key", "left_semi").groupBy("digest").agg(F.count("*").alias("size"), best.alias("best")).where("size > 1")
    groups = common.cut(groups, "groups")  # so that a join of its own can split a large group's rows
    d = index.content.join(groups, "digest", "left")
    single = F.col("size").isNull()
    return d.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.bitwise_not("row") == F.col("best.row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op13_exact_copies(spark, sf_dir: str) -> DataFrame:
    return copies(build(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP13_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256 from documents),
g as (select text_sha256, count(*) group_size, arg_min(doc_id, (-n, doc_id)) keep_id from d group by 1)
select doc_id, keep_id, group_size::bigint group_size, doc_id = keep_id kept, text_sha256 from d join g using (text_sha256)
"""
