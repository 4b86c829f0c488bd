"""Spelling variants against edit distances of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, list string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "w", "n", "l") for d, t in rows], SCHEMA).repartition(3)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows):
    c = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def expected(rows):
    c = counts(rows)
    form, near = {}, {}
    for w in c:
        near[w] = [v for v in c if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        form[w] = best if best is not None and c[best] >= 2 * c[w] else None
    out = []
    for w in c:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, c[w], len(near[w]), c[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["hello", "strand", "müßig", "kÀÿes", "aaaaa", "aaaaaa", "abcabcabc", "zzzzy", "long" * 30, "a" * 300, "ÀÀÀÀÀ", "contract"]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 9, 40])
        for _ in range(14):
            v = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                k, c = rng.randrange(len(v) + 1), rng.choice("abzÿ×÷")
                match rng.randrange(3):
                    case 0:
                        v.insert(k, c)
                    case 1:
                        v[min(k, len(v) - 1)] = c
                    case 2:
                        del v[min(k, len(v) - 1)]
            words += ["".join(v)] * rng.choice([2, 3, 5, 20])
    words += ["".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7]))) for _ in range(600)]
    rng.shuffle(words)
    out = [(i, " ".join(words[i * 20 : (i + 1) * 20])) for i in range(len(words) // 20 + 1)]
    return [*out, (None, "Hello HELLO hello3helloĀstrand"), (7, out[7][1]), (900, None), (901, ""), (902, "1 2 中文 ab"), (903, "x" * 70_000 + " " + "x" * 70_001), (904, "x" * 70_000), (905, "x" * 70_000), (906, "x" * 70_001), (907, "x" * 70_001), (None, None), (-5, "Straße STRAẞE é́toile")]


def test_variants_against_all_pairs(spark, rows):
    want = expected(rows)
    assert sum(w[1] is not None for w in want) > 50 and any(w[2] != (w[1] or w[0]) for w in want)
    assert found(spelling.variants(docs(spark, rows))) == want


def test_many_altered_words(spark):
    rows = [(i, "alphabet alphabets betterment") for i in range(2000)]
    want = expected(rows)
    assert len(want) > 3
    assert found(spelling.variants(docs(spark, rows))) == want


def test_empty_table(spark, rows):
    assert spelling.variants(docs(spark, rows).limit(0)).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, "few")])).count() == 0


def test_one_scan_of_one_list():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.choice([5, 6, 7]))) for _ in range(900)})
    flat, off = spelling.latin(pa.array(words))
    a, b, at = spelling.scan(flat, off, np.zeros(1, np.int64))
    got = sorted(zip(a.tolist(), b.tolist()))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]
    for i, j, k in zip(a.tolist(), b.tolist(), at.tolist()):
        assert words[i][:k] == words[j][:k] and words[i][k : k + 1] != words[j][k : k + 1]


def test_checksums():
    texts = ["", "a", "word", "é" * 40, "q" * 65, "r" * 500]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    begins = ends - [len(t.encode()) for t in texts]
    start = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(texts))], np.uint32)
    assert spelling.crcs(data, begins, ends, start).tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]
