"""Exact copies and the cuckoo-filter index against dictionaries of texts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import exact_copies as x

SCHEMA = "doc_id long, text string, digest string, key string, shard string, row string, n_chars string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "a", "b", "c", "d", "e") for d, t in rows], SCHEMA).repartition(3)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((d, t))
    out = []
    for t, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out += [(d, keep, len(g), hashlib.sha256(t.encode()).hexdigest()) for d, _ in g]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


ROWS = [
    (0, None), (1, ""), (2, " \t\r\n\x0b\x0c"), (3, "a b"), (4, "ab"), (5, "a b"), (6, "a  b"), (-7, "a\tb\n"), (8, "A b"), (9, "\U0001f600 x"), (10, "\U0001f600x"),
    (11, "é" * 5), (12, "é" * 5), (13, "long " * 60_000), (14, "long" * 60_000), (None, "a  b"), (15, "unique"), (15, "unique"), (15, "other"), (-(2**63), "ab"),
]


def test_copies_against_groups(spark):
    rows = ROWS + [(100 + i, "hot text") for i in range(300)] + [(500 + i, f"text {i // 2}") for i in range(200)]
    got = x.copies(x.build(docs(spark, rows)))
    assert found(got) == expected(rows)
    kept = got.where("kept").groupBy("text_sha256").count()
    assert kept.where("count <> 1").count() == 0 and kept.count() == len({bare(t) for _, t in rows})
    assert got.where("kept and doc_id is distinct from keep_id").count() == 0


def test_empty_table(spark):
    index = x.build(docs(spark, ROWS).limit(0))
    assert x.copies(index).count() == 0
    more = x.insert(index, docs(spark, ROWS))
    assert found(x.copies(more)) == expected(ROWS)


def test_inserts_and_deletes(spark):
    first = ROWS + [(100 + i, f"text {i // 3}") for i in range(90)]
    second = [(300 + i, f"text {i}") for i in range(60)] + [(400, "fresh"), (401, "fresh "), (402, "alone")]
    a = x.build(docs(spark, first))
    b = x.insert(a, docs(spark, second))
    assert found(x.copies(b)) == expected(first + second)
    assert found(x.copies(a)) == expected(first)
    gone = [r[0] for r in (first + second)[::2]]
    left = [r for r in first + second if r[0] not in gone or r[0] is None]
    c = x.delete(b, spark.createDataFrame([(g,) for g in gone if g is not None], "doc_id long"))
    assert found(x.copies(c)) == expected(left)
    asked = docs(spark, [(1, "text 0 "), (2, "text 59"), (3, "never seen"), (4, "fresh"), (5, None)])
    held = {bare(t) for _, t in left}
    assert {r.doc_id: r.held for r in x.lookup(c, asked).collect()} == {1: "text0" in held, 2: "text59" in held, 3: False, 4: "fresh" in held, 5: "" in held}
    d = x.insert(c, docs(spark, second))
    assert found(x.copies(d)) == expected(left + second)


def test_overflow_in_a_later_run(spark):
    few = docs(spark, [(i, f"t{i}") for i in range(50)])
    many = spark.range(30_000).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 29_000).cast("string")).alias("text"))
    a = x.build(few)
    small = a.filters.agg(F.max("log2")).first()[0]
    b = x.insert(a, many)
    assert b.filters.agg(F.max("log2")).first()[0] > small
    got = x.copies(b).groupBy("group_size").count().collect()
    sizes = defaultdict(int)
    for i in range(50):
        sizes[f"t{i}"] += 1
    for i in range(30_000):
        sizes[f"t{i % 29_000}"] += 1
    want = defaultdict(int)
    for n in sizes.values():
        want[n] += n
    assert {r.group_size: r["count"] for r in got} == dict(want)
    # no key is missing from the filters
    assert x.lookup(b, many).where("not held").count() == 0
    gone = x.delete(b, many.select("doc_id"))
    assert x.copies(gone).count() == 50 and x.lookup(gone, few).where("not held").count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_filter_holds_its_keys(n):
    keys = np.random.Generator(np.random.PCG64(n)).integers(-(2**63), 2**63 - 1, n)
    f = x.Cuckoo.of(keys)
    assert f.contains(keys).all() and (f.table > 0).sum() == n
    others = np.random.Generator(np.random.PCG64(n + 1)).integers(-(2**63), 2**63 - 1, 20_000)
    assert f.contains(others).mean() < 0.001
    f.delete(keys[: n // 2])
    assert f.contains(keys[n // 2 :]).all() and (f.table > 0).sum() == n - n // 2
    assert f.contains(keys[: n // 2]).sum() <= n // 100


def test_filter_tells_when_it_is_full():
    keys = np.arange(1, 400, dtype=np.int64) * 0x9E3779B97F4A7C1
    assert len(x.Cuckoo(6).insert(keys)) > 0
    assert x.Cuckoo.of(keys).contains(keys).all()


def test_keys_that_share_a_fingerprint():
    # same bucket and tag: as many copies as there are keys, and each deletion takes one
    keys = np.array([5, 5, 5], np.int64)
    f = x.Cuckoo(6)
    assert not len(f.insert(keys))
    f.delete(keys[:2])
    assert f.contains(keys[:1]).all()
    f.delete(keys[:1])
    assert not f.contains(keys[:1]).any()
