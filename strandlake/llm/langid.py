"""Language identification by n-gram Bloom filters that share one bit-sliced table.

Every cell of the table is a bitmask of languages; the mask of an n-gram is the AND of its cells, that is, all
languages whose filter holds it. A text's popcount per language, corrected for the filter's false positives, decides.

N-grams are four bytes of the text with A-Z as a-z and runs of other ASCII than letters as one blank. A language's
filter holds the n-grams whose rate in its training texts is at least `least_rate` and at least half of the highest
rate in any language, so there are at most 1 / least_rate of them. Training takes about `sample` labelled texts
a language (a documented bound), chosen by a hash of doc_id; prediction covers every whole text.

Null text, or no letter in it: `und` with score 0, also when there is nothing to learn from. Null doc_id: never trained
on, held_out is null. Score: the language's share of all corrected rates; rate: its corrected rate alone, which does not
depend on the other languages. In a tie the first name counts. Texts of any length are read whole; other columns than
those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

N = 4
SAMPLE = 3000
LEAST_RATE = 1e-5
TABLE_LOG2 = 20
HASHES = 3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of all texts as 32-bit numbers, and where each text's begin (one more entry for the end)."""
    data, offsets = words.bytes_of(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    # three blanks stand between texts, so that a single letter has n-grams of its own
    gap = np.arange(1, n + 1) * 3
    wide = np.full(len(data) + 3 * n + 3, 32, np.uint8)
    wide[np.arange(len(data)) + np.repeat(gap, np.diff(offsets))] = _FOLD[data]
    begins = offsets + 3 * np.arange(n + 1)
    blank = wide == 32
    keep = np.ones(len(wide), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    for d in range(3):
        keep[begins + d] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    x = wide[keep].astype(np.uint32)
    g = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    starts = place[begins]
    full = (x[2:-1] != 32) | (x[3:] != 32) | (x[1:-2] != 32)
    at = np.concatenate(([0], np.cumsum(full)))
    return g[full], at[np.minimum(starts, len(g))]


def cells(g: np.ndarray, k: int) -> np.ndarray:
    """The k-th cell of every n-gram."""
    x = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)


class LanguageFilters:
    """Bloom filters of all languages in one table of bitmasks (64 languages a word)."""

    def __init__(self, languages: list[str], held: dict[str, np.ndarray]):
        self.languages = languages
        self.table = np.zeros((max(1, -(-len(languages) // 64)), 1 << TABLE_LOG2), np.uint64)
        for i, name in enumerate(languages):
            for k in range(HASHES):
                self.table[i // 64, cells(held.get(name, np.zeros(0, np.uint32)), k)] |= np.uint64(1 << i % 64)
        ones = [np.count_nonzero(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]
        self.false = np.array([(o / (1 << TABLE_LOG2)) ** HASHES for o in ones])

    def rates(self, g: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For every text and language the share of its n-grams in the filter, less the false positives."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        at = [cells(g, k) for k in range(HASHES)]
        n = np.maximum(1, np.diff(starts))
        for w in range(len(self.table)):
            mask = self.table[w][at[0]] & self.table[w][at[1]] & self.table[w][at[2]]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                sums = np.concatenate(([0], np.cumsum((mask >> np.uint64(i % 64) & np.uint64(1)).astype(np.int32), dtype=np.int64)))
                out[:, i] = (np.diff(sums[starts]) / n - self.false[i]) / (1 - self.false[i])
        return np.maximum(out, 0)


def fit(labelled: DataFrame, sample: int = SAMPLE, least_rate: float = LEAST_RATE) -> LanguageFilters:
    """Filters from (doc_id, text, lang); takes about `sample` texts of each language."""
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null")
    # one number a language goes to the driver, so that no text is shuffled by its language
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return LanguageFilters([], {})
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["count"])])[F.col("lang")]
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.where(share * size < F.lit(sample)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.pieces(batch, "text", 1 << 20):
                lang = np.array(b.column(0).to_pylist(), object)
                g, starts = grams(b.column(1))
                for name in set(lang.tolist()):
                    of = np.concatenate([g[a:z] for a, z, x in zip(starts[:-1], starts[1:], lang) if x == name])
                    u, c = np.unique(of, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(u), pa.string()), "gram": pa.array(u.astype(np.int64)), "n": pa.array(c, pa.int64())})

    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = common.cut(counted, "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilters([], {})
    rate = counted.join(counted.groupBy("lang").agg(F.sum("n").alias("total")), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= least_rate)
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    held: dict[str, list[int]] = {}
    for r in rate.join(top, "gram").where("rate >= top / 2").select("lang", "gram").toLocalIterator():
        held.setdefault(r["lang"], []).append(r["gram"])
    return LanguageFilters(sorted(totals), {k: np.array(v, np.uint32) for k, v in held.items()})


def predict(documents: DataFrame, filters: LanguageFilters, into: str = "predicted") -> DataFrame:
    """All columns of documents, and `into` struct<lang, score, rate>."""
    if common.fresh(documents.columns, into) != into:
        raise ValueError(f"documents have a column {into}")
    sent = documents.sparkSession.sparkContext.broadcast(filters)
    text = documents.columns.index("text")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            for b in words.pieces(batch, batch.schema.names[text]):
                g, starts = grams(b.column(text))
                langs, scores, highest = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
                if f.languages:
                    rates = f.rates(g, starts)
                    best, total, highest = rates.argmax(1), rates.sum(1), rates.max(1)
                    scores = np.where(total > 0, highest / np.maximum(total, 1e-300), 0.0)
                    data, offsets = words.bytes_of(b.column(text))
                    letter = np.concatenate(([0], np.cumsum(_FOLD[data] != 32)))
                    ascii_ = np.concatenate(([0], np.cumsum((_FOLD[data] != 32) & (data < 128))))
                    some, plain = np.diff(letter[offsets]) > 0, np.diff(ascii_[offsets]) > 0
                    for i in range(b.num_rows):
                        if plain[i] or some[i] and any(c.isalpha() for c in b.column(text)[i].as_py()):
                            langs[i] = f.languages[best[i]]
                        else:
                            scores[i] = highest[i] = 0
                col = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(highest, pa.float64())], ["lang", "score", "rate"])
                yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, into])

    fields = [f"`{n}` {t}" for n, t in documents.dtypes]
    return documents.mapInArrow(decide, ", ".join([*fields, f"`{into}` struct<lang:string,score:double,rate:double>"]))


def training_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the documents that are not held out."""
    return common.one_column(documents, "doc_id", "text", "lang").where("lang is not null and crc32(cast(doc_id as string)) % 5 <> 0")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = predict(common.one_column(docs, "doc_id", "text"), fit(training_rows(docs)))
    return told.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"))
