"""Exact n-gram Jaccard join over word shingles with count-vector R-trees.

Every shingle belongs to one of G groups (the leading bits of its hash); a document is the point of its group
counts, and the overlap of two documents is at most the sum of the coordinate minima of their points. One tree over
all documents would compare nearly all of them, because the points of unrelated documents of one size lie close
together; so trees are built per block of documents that share a shingle of their prefixes (the first
n - ceil(t n) + 1 shingles of a fixed global order, of which two similar documents always share one): the prefixes
carry most of the pruning, the trees the rest. The order puts shingles of common sketch cells last, so that shared
passages and boilerplate seldom make blocks. A block is named by its smallest document, its hub. Blocks with the same
hub are one block, and a hub's block joins that of the smaller hub with which it shares most shingles, since the
shingles of one shared passage make several hubs with nearly the same members.

Links are only needed up to their components:
1. equal sets form one class, with the smallest doc_id as its member;
2. every member of a block is a candidate with a hub; candidates that sizes and the bound leave are verified on the
   whole texts, and the components of the links found are labelled; this is done twice, the second time with the
   smallest members of other components;
3. in each block that still holds several components, the R-tree finds all pairs of different components that the
   bound leaves; these are verified too. Pairs within one component cannot change the result. Blocks of more than
   BLOCK_CHUNK members are cut by size into overlapping groups outside of which no sizes fit, and then into chunks.

Null doc_id: the row is counted but has no component (null) unless a copy has an id. Null or blank text: n_shingles
0, a component of its own. Rows that share a doc_id count as one document that holds each of their texts. Texts of any
length are read whole; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

CELLS_LOG2 = 21
CHUNK = 256
BLOCK_CHUNK = 1024


def needed(na, nb, percent: int):
    """Smallest overlap with 100 * overlap >= percent * union."""
    return -((-percent * (na + nb)) // (100 + percent))


def groups_of(size: int) -> int:
    """Number of groups beside `size` parity bytes."""
    return max(16, size // 4)


def point(s: np.ndarray) -> tuple[bytes, bytes]:
    """Group counts of a sorted set, and the parity bits of two to four cells a shingle, by its hashes' low bits.

    Both sizes are powers of two in proportion to the set's, so a pair compares at the coarser of its two.
    """
    g = max(4, min(12, int(len(s) // 4).bit_length()))
    k = groups_of(1 << g).bit_length() - 1
    counts = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    cells = np.bincount((s & np.uint64((8 << g) - 1)).astype(np.int64), minlength=8 << g)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint16).tobytes(), np.packbits((cells & 1).astype(bool)).tobytes()


def counts_of(raw: bytes, size: int) -> np.ndarray:
    """Group counts beside `size` parity bytes."""
    return np.frombuffer(raw, np.uint8 if len(raw) == groups_of(size) else np.uint16)


def coarser(c: np.ndarray, size: int) -> np.ndarray:
    """Group counts of fewer groups."""
    return c if len(c) == size else c.reshape(size, -1).sum(1)


def folded(p: np.ndarray, size: int) -> np.ndarray:
    """Parity bytes of fewer cells."""
    while len(p) > size:
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return p


def may_link(na: int, nb: int, ca: bytes, cb: bytes, pa: bytes, pb: bytes, percent: int) -> bool:
    """False only if the summed minima or the odd cells (each holds a shingle of one set alone) rule a link out."""
    x, y = counts_of(ca, len(pa)), counts_of(cb, len(pb))
    g, least = min(len(pa), len(pb)), needed(na, nb, percent)
    k = groups_of(g)
    if int(np.minimum(coarser(x, k), coarser(y, k)).sum(dtype=np.int64)) < least:
        return False
    odd = np.bitwise_count(folded(np.frombuffer(pa, np.uint8), g) ^ folded(np.frombuffer(pb, np.uint8), g)).sum(dtype=np.int64)
    return na + nb - odd >= 2 * least


class CountTree:
    """R-tree over group counts, packed by sorting and tiling; finds pairs whose bound reaches the needed overlap."""

    LEAF = 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points.argmax(1), sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # per level: lower sizes, upper sizes, upper counts
        lo, hi, top = self.sizes, self.sizes, self.points
        while len(lo) > 1:
            at = np.arange(0, len(lo), self.LEAF)
            lo, hi, top = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(top, at, axis=0)
            self.levels.append((lo, hi, top))

    @staticmethod
    def _open(a, b, lo, hi, top, percent) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(0, len(a), 4096):
            i, j = a[k : k + 4096], b[k : k + 4096]
            small = np.maximum(lo[i], -(-lo[j] * percent // 100)) + np.maximum(lo[j], -(-lo[i] * percent // 100))
            fits = (hi[i] * 100 >= lo[j] * percent) & (hi[j] * 100 >= lo[i] * percent)
            bound = np.minimum(top[i], top[j]).sum(1)
            out[k : k + 4096] = fits & (bound >= needed(small, 0, percent))
        return out

    def pairs(self, percent: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs whose summed minima reach the needed overlap; with `apart`, only those of different labels."""
        n = len(self.sizes)
        apart = np.arange(n) if apart is None else apart[self.order]
        if n < 2:
            return np.zeros(0, int), np.zeros(0, int)
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            lo, hi, top = self.levels[level]
            keep = self._open(a, b, lo, hi, top, percent)
            a, b = a[keep], b[keep]
            below = n if level == 0 else len(self.levels[level - 1][0])
            i = (a[:, None] * self.LEAF + np.arange(self.LEAF)[None, :]).repeat(self.LEAF, 1)
            j = np.tile(b[:, None] * self.LEAF + np.arange(self.LEAF)[None, :], (1, self.LEAF))
            i, j = i.ravel(), j.ravel()
            ok = (i < below) & (j < below) & ((i < j) if level == 0 else (i <= j))
            a, b = i[ok], j[ok]
        ok = apart[a] != apart[b]
        a, b = a[ok], b[ok]
        keep = self._open(a, b, self.sizes, self.sizes, self.points, percent)
        return self.order[a[keep]], self.order[b[keep]]


def _describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, common, counts, odd) of every row; common: the prefix's shingles of common cells."""

    def fold(b: pa.RecordBatch, total: np.ndarray) -> None:
        for part in words.pieces(b, "text"):
            sets = words.shingle_sets(part.column(1), k)
            if sets:
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64), 1)

    cells = common.sketch_sum(docs, fold, 1 << CELLS_LOG2)
    # class 0: up to 2.5 times the mean cell; then one class for each doubling
    rank = np.clip(np.floor(np.log2(np.maximum(1, cells) / (2.5 * max(1.0, cells.mean())))) + 1, 0, 60).astype(np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch in batches:
            for part in words.pieces(batch, "text"):
                n, k1, k2, prefixes, often, counts, odd = [], [], [], [], [], [], []
                for s in words.shingle_sets(part.column(1), k):
                    n.append(len(s))
                    m = words.mix(s)
                    k1.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(words.mix(m ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)))
                    if not len(s):
                        prefixes.append(np.zeros(0, np.int64))
                        often.append(np.zeros(0, np.int64))
                        counts.append(b"")
                        odd.append(b"")
                        continue
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    c = order[(s >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)]
                    at = np.argsort(c, kind="stable")[:length] if c.any() else np.arange(length)
                    first, rare = s[at].view(np.int64), c[at] == 0
                    prefixes.append(first[rare])
                    often.append(first[~rare])
                    c, p = point(s)
                    counts.append(c)
                    odd.append(p)
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (prefixes, often)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in (n, k1, k2)), *lists, pa.array(counts, pa.binary()), pa.array(odd, pa.binary())],
                    names=["doc_id", "n", "k1", "k2", "prefix", "common", "counts", "odd"],
                )

    return common.cut(docs.mapInArrow(describe, "doc_id long, n long, k1 long, k2 long, prefix array<long>, common array<long>, counts binary, odd binary"), "shingles")


def _classes(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, k1, k2, rep, rows) of every set, and the rows of told that stand for their sets, each once.

    Rows whose doc_id surely has no equal set stay where they are; only others are shuffled.
    """
    key = ["n", "k1", "k2"]
    classes = common.cut(told.where("n > 0").groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    copied = told.where("doc_id is not null").select("doc_id", *key).join(classes.where("rows > 1").select(key), key, "left_semi").select("doc_id")
    sent = common.id_filter(copied)
    wide = told.where("n > 0 and doc_id is not null")
    maybe = common.passing(wide, "doc_id", sent).join(classes.where("rep is not null").withColumnRenamed("rep", "doc_id"), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    points = common.passing(wide, "doc_id", sent, inside=False).unionByName(maybe.select(wide.columns))
    return classes, common.cut(points.drop("k1", "k2"), "points")


def _blocks(points: DataFrame) -> DataFrame:
    """(doc_id, hub, count): the shingles of a document's prefix by the smallest document that has them in its own."""
    rare, often = (points.select(F.explode(c).alias("token"), "doc_id") for c in ("prefix", "common"))
    # no more documents hold a rare shingle than its cell's limit
    same = Window.partitionBy("token")
    found = rare.select("doc_id", F.min("doc_id").over(same).alias("hub"), F.max("doc_id").over(same).alias("last")).where("hub < last").select("doc_id", "hub")
    # as a table of its own, so that the join below has an exchange on either side and a hot token can be split
    shared = common.cut(often.groupBy("token").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last"), "hubs")
    return common.cut(found.union(often.join(shared, "token").select("doc_id", "hub")).groupBy("doc_id", "hub").count(), "blocks")


def _joined(blocks: DataFrame) -> DataFrame:
    """The blocks, each hub replaced by the smaller hub with which it shares most shingles (the smallest in a tie)."""
    up = blocks.where("hub < doc_id").groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("up"))
    up = common.cut(up.join(blocks.select(F.col("hub").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "hub"), "hubs")
    return common.cut(blocks.join(up, "hub", "left").select("doc_id", F.coalesce("up", "hub").alias("hub")).distinct(), "blocks")


def _bounded(pairs: DataFrame, points: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and the bounds leave; points are joined to pairs of fitting sizes only."""
    both = pairs
    for x in "ab":
        both = both.join(sizes.select(F.col("doc_id").alias(x), F.col("least").alias(f"l{x}"), F.col("most").alias(f"m{x}")), x)
    both = common.cut(both.where(f"100 * ma >= {percent} * lb and 100 * mb >= {percent} * la").select("a", "b"), "fitting")
    for x in "ab":
        both = both.join(points.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"), F.col("odd").alias(f"p{x}")), x)
    both = both.where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(x)).to_pylist() for x in ("na", "nb", "ca", "cb", "pa", "pb")]
            yield b.select(["a", "b"]).filter(pa.array([may_link(*row, percent) for row in zip(*columns)], pa.bool_()))

    return common.cut(both.select("a", "b", "na", "nb", "ca", "cb", "pa", "pb").mapInArrow(test, "a long, b long").distinct(), "candidates")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts link. Pairs of one b are dealt in chunks, each with b's text first."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    # a filter of fixed size lets most other texts go before the shuffle; the join decides
    texts = common.passing(docs, "doc_id", common.id_filter(ids))
    hot = common.cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("parts")).where("parts > 1"), "parts")
    salted = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("salt"))
    asks = salted.select(F.col("a").alias("doc_id"), "b", "salt", F.lit(1).alias("role")).union(salted.select(F.col("b").alias("doc_id"), "b", "salt", F.lit(0).alias("role")).distinct())
    dealt = texts.join(asks, "doc_id").repartition(common.partitions(docs), "b", "salt").sortWithinPartitions("b", "salt", "role").select("b", "salt", "role", "doc_id", "text")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hubs = None, []  # one group's hub texts are held, the others pass by
        for batch in batches:
            for part in words.pieces(batch, "text"):
                found = []
                for b, salt, role, a, s in zip(*(part.column(i).to_pylist() for i in range(4)), words.shingle_sets(part.column(4), k)):
                    if (b, salt) != key:
                        key, hubs = (b, salt), []
                    if not role:
                        hubs.append(s)
                    elif any(len(s) and len(h) and 100 * (o := len(np.intersect1d(s, h, assume_unique=True))) >= percent * (len(s) + len(h) - o) for h in hubs):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return common.cut(dealt.mapInArrow(test, "a long, b long").distinct(), "links")


def _labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, c) of every id under the links."""
    found = common.components(links, "jaccard")
    return common.cut(ids.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("c")), "labels")


def _mixed(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows) of groups with members of more than one component; a table of its own, so that hot keys can be split."""
    out = members.groupBy(keys).agg(F.count("*").alias("rows"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return common.cut(out.where("c0 <> c1").drop("c0", "c1"), "mixed")


def _within(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of different components in blocks (hub, doc_id, c, least, most), in chunks of bounded size."""
    m = members.join(_mixed(members, ["hub"]), "hub")
    # sizes that fit are of one class or of neighbours; group g holds the classes g and g + 1
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    of = lambda c: F.floor(F.log(c) / F.lit(step)).cast("int")
    groups = F.when(F.col("rows") <= BLOCK_CHUNK, F.array(F.lit(-2))).otherwise(F.sequence(of("least") - 1, of("most")))
    m = common.cut(m.select("hub", "doc_id", "c", F.explode(groups).alias("g")), "members")
    m = m.join(_mixed(m, ["hub", "g"]).withColumn("parts", F.ceil(F.col("rows") / F.lit(BLOCK_CHUNK)).cast("int")), ["hub", "g"])
    m = m.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("doc_id", "c", "hub", "g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    key = ["hub", "g", "i", "j"]
    m = m.join(points.select("doc_id", "n", "counts", "odd"), "doc_id").repartition(common.partitions(points), *key).sortWithinPartitions(*key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for t in common.groups(batches, key):
            ids, c, n = (t[x].to_numpy() for x in ("doc_id", "c", "n"))
            if (c == c[0]).all():
                continue
            odd = [np.frombuffer(x, np.uint8) for x in t["odd"].to_pylist()]
            counts = [counts_of(x, len(p)) for x, p in zip(t["counts"].to_pylist(), odd)]
            sizes = np.array([len(x) for x in odd])
            found = []
            for g in np.unique(sizes):  # pairs at the coarser grouping of the two
                at = np.flatnonzero(sizes >= g)
                tree = CountTree(np.array([coarser(counts[x], groups_of(g)) for x in at], np.int32), n[at].astype(np.int64))
                x, y = tree.pairs(percent, c[at])
                cells = np.array([folded(odd[i], g) for i in at])
                far = np.concatenate([np.bitwise_count(cells[x[k : k + 4096]] ^ cells[y[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
                x, y = at[x], at[y]
                ok = (np.minimum(sizes[x], sizes[y]) == g) & (n[x] + n[y] - far >= 2 * needed(n[x] + n[y], 0, percent))
                found += zip(np.minimum(ids[x[ok]], ids[y[ok]]).tolist(), np.maximum(ids[x[ok]], ids[y[ok]]).tolist())
            new = [p for p in set(found) if p not in seen and p[0] != p[1]]
            if len(seen) < 1 << 16:
                seen.update(new)
            if new:
                yield pa.RecordBatch.from_pydict({"b": pa.array([p[0] for p in new], pa.int64()), "a": pa.array([p[1] for p in new], pa.int64())})

    return common.cut(m.select(*key, "doc_id", "c", "n", "counts", "odd").mapInArrow(join, "b long, a long").distinct().select("a", "b"), "pairs")


def similar_components(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = common.one_column(documents, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    told = _describe(docs, k, percent)
    rows = common.cut(told.select("doc_id", "n", "k1", "k2"), "rows")
    classes, points = _classes(told)
    common.drop(told)
    sizes = common.cut(points.groupBy("doc_id").agg(F.min("n").alias("least"), F.max("n").alias("most")), "sizes")
    ids = sizes.select("doc_id")
    blocks = _blocks(points)

    # of each document's hubs, the one with most shared shingles and the smallest; step 3 finds what this leaves out
    stars = blocks.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"), "count")
    stars = stars.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("most"), F.min("b").alias("least"))
    stars = common.cut(stars.select("a", F.explode(F.array_distinct(F.array("most", "least"))).alias("b")), "stars")
    found = _bounded(stars, points, sizes, percent)
    links = _verified(found, docs, k, percent)
    labels = _labels(ids, links)
    joined = _joined(blocks)
    common.drop(blocks)

    m = common.cut(joined.join(labels, "doc_id"), "members")
    hubs = m.groupBy("hub", "c").agg(F.min("doc_id").alias("first"))
    low = hubs.groupBy("hub").agg(F.min(F.struct("c", "first")).alias("low"), F.max(F.struct("c", "first")).alias("high")).where("low.c <> high.c")
    again = m.join(common.cut(low, "hubs"), "hub").select("doc_id", "c", F.explode(F.array("low", "high")).alias("x")).where("c <> x.c")
    again = again.select(F.greatest("doc_id", "x.first").alias("a"), F.least("doc_id", "x.first").alias("b")).distinct()
    again = common.cut(again.join(stars, ["a", "b"], "left_anti"), "again")
    common.drop(m)
    found = _bounded(again, points, sizes, percent)
    links = common.cut(links.union(_verified(found, docs, k, percent)), "links")
    labels = _labels(ids, links)

    m = common.cut(joined.join(labels, "doc_id").join(sizes, "doc_id"), "members")
    common.drop(joined)
    rest = _within(m, points, percent)
    common.drop(m)
    rest = common.cut(rest.join(stars, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti"), "pairs")
    links = common.cut(links.union(_verified(rest, docs, k, percent)), "links")
    final = classes.join(_labels(ids, links), classes.rep == F.col("doc_id"), "left").select("n", "k1", "k2", "c")
    out = rows.join(common.cut(final, "classes"), ["n", "k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), sh as (
  select distinct doc_id, case when len(w) >= 5 then array_to_string(w[p:p + 4], ' ') else array_to_string(w, ' ') end s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p from w where len(w) > 0)
), n as (select doc_id, count(*) n from sh group by 1
), o as (select a.doc_id a, b.doc_id b, count(*) o from sh a join sh b using (s) where a.doc_id <> b.doc_id group by 1, 2
), links as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)
), reach(v, c) as (select doc_id, doc_id from documents union select b, c from reach join links on a = v
), comp as (select v, min(c) c from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, c component_id from documents d join comp on v = d.doc_id left join n using (doc_id)
"""
