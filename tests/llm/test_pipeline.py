"""The pipeline's stages one after the other, each against brute force on what the stage before it kept."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from strandlake.llm import tokens
from test_operators import shingles, words_of


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    sounds = {"en": ["the", "and", "thing", "with", "ation"], "fr": ["que", "eau", "tion", "elle", "pour"]}
    # many different words, so that neighbours of a passage do not align by chance
    word = lambda k: "".join(rng.choice(sounds[k]) for _ in range(rng.randrange(1, 4))) + "".join(rng.choice("bcdfgkm") for _ in range(3))
    prose = lambda k, n: " ".join(word(k) for _ in range(n))
    rows = [(i, prose(k, rng.randrange(60, 160)), k) for i in range(40) for k in ["en" if i % 3 else "fr"]]
    copy = rows[4][1].split()
    copy[20] = "changed"
    passage, item = prose("en", 80), prose("en", 15)
    rows += [(50, rows[3][1], "en"), (51, " ".join(copy), "en"), (60, None, "en"), (61, "12 34 --", "fr")]
    rows += [(i, f"{prose('en', 60)} {passage} {prose('en', 30)}", "en") for i in (70, 71, 72)]
    rows += [(80, f"{prose('en', 100)} {item} {prose('en', 20)}", "en"), (81, item, "en")]
    d = spark.createDataFrame([(i, t, k, "s", None if t is None else len(t)) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose("fr", 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        if name != "packing":
            assert docs.columns == d.columns
    texts = {i: t for i, t, _ in rows}
    after = [{r["doc_id"]: r["text"] for r in x.collect()} for x in kept[:4]]
    assert after[0] == {i: t for i, t in texts.items() if i not in (60, 61)}
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    sets = {i: shingles(t) for i, t in after[0].items()}
    assert after[1] == {i: t for i, t in after[0].items() if not any(j < i and linked(sets[i], sets[j]) for j in sets)}
    assert 50 not in after[1] and 51 not in after[1]
    assert set(after[2]) == set(after[1])
    for i, t in after[1].items():
        want = t if i not in (71, 72) else None
        assert want is None or after[2][i] == want
    for i in (71, 72):
        w = words_of(texts[i])
        assert words_of(after[2][i]) == w[:60] + w[140:]
    assert 81 not in after[3] and words_of(after[3][80]) == [w for k, w in enumerate(words_of(texts[80])) if not 100 <= k < 115]
    assert {i: t for i, t in after[3].items() if i != 80} == {i: t for i, t in after[2].items() if i not in (80, 81)}
    library = tokens.encoder("word_bpe_49k.json").library
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in after[3].items()}
    got: dict[int, int] = {}
    for r in kept[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    assert re.match("language", corpus_pipeline.STAGES[0][0])


def test_short_texts_of_related_languages_stay(spark, tmp_path):
    rng = random.Random(22)
    shared = ["casa", "mano", "luna", "vento", "terra", "sole", "grande", "mare"]
    rows = [(i, " ".join(rng.choice(shared) for _ in range(rng.randrange(2, 30))), k) for i in range(400) for k in ["it", "es", "pt", "ro", "la"][i % 5 : i % 5 + 1]]
    rows += [(900, "zzxq qqxz wwqx", None), (901, "12 --", "es"), (902, None, None)]
    d = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, predicted int, match int")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, d, str(tmp_path)).collect()}
    assert kept == set(range(400))


def test_empty_tables_repeated_ids_and_clashing_columns(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, predicted string, match string, passage_key long, spans string"
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en"), (1, text, "en"), (None, text + " more", "en"), (2, "", "en"), (3, "other words of the same language here", "en")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, some in (("none", []), ("few", rows)):
        docs = spark.createDataFrame([(*r, "s", None, "p", "m", 5, "x") for r in some], kind)
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{name}-{stage}"))
            if stage != "packing":
                assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
        if name == "none":
            assert docs.count() == 0
        else:
            assert {r["doc_id"] for r in docs.collect()} == {1, None, 3}
