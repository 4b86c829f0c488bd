"""The operators on Spark against brute force, with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandlake.llm import common, decontaminate, html_text, jaccard, langid, licenses, near_vectors, packing, passages, token_counts, tokens, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, match string, predicted string, token long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, "m", "p", 2) for d, t in rows], SCHEMA).repartition(3)


def prose(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(0, None), (1, ""), (2, "  \n"), (3, "one two"), (4, "One  two"), (5, "!!! 123")]
    base = prose(rng, 120)
    for i in range(6, 16):  # near copies of one text, each with its own edits
        w = base.split()
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        out.append((i, " ".join(w)))
    shared = prose(rng, 70)
    out += [(i, f"{prose(rng, rng.randrange(30, 90))}\n{shared}\n{prose(rng, 25)}") for i in range(20, 26)]
    out += [(i, prose(rng, rng.randrange(1, 150))) for i in range(30, 45)]
    out += [(50, prose(rng, 9000, 10**6)), (51, "line of words again " * 40), (52, "line of words again " * 30)]
    return [*out, out[8], (None, out[9][1])]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(spark, rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    got = jaccard.similar_components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"])), r
    assert len({top(d) for d in sets}) < len(sets)


def test_jaccard_of_nothing(spark):
    assert jaccard.similar_components(docs(spark, [])).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_passages_are_found_after_their_first_document(spark, rows):
    found = passages.passages(docs(spark, rows)).collect()
    spans = defaultdict(set)
    for r in found:
        spans[r["doc_id"]] |= set(range(r["begin_word"], r["end_word"]))
        assert r["earlier_doc_id"] < r["doc_id"] and r["matched_words"] <= r["n_words"] and r["n_words"] >= passages.LEAST
    seen: dict[tuple, int] = {}
    by_id = sorted((d, words_of(t)) for d, t in rows if d is not None)
    for d, w in by_id:
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), d) < d:
                assert set(range(i, i + 50)) <= spans[d], d
    assert not {d for d in spans if 30 <= d < 51} and 20 not in spans
    left = passages.without_passages(docs(spark, rows))
    assert left.columns == docs(spark, []).columns
    kept = {r["doc_id"]: r for r in left.collect()}
    texts = dict(rows)
    for d in (0, 1, 2, 3, 6, 20, 30, 50):
        assert kept[d]["text"] == texts[d] and kept[d]["match"] == "m"
    for d in range(21, 26):
        assert kept[d]["n_chars"] == len(kept[d]["text"]) and words_of(kept[d]["text"]) == [x for i, x in enumerate(words_of(texts[d])) if i not in spans[d]]


def planted(rng, n, changed, even):
    """A passage and its copy with changed words, evenly spaced or not, none near the ends."""
    p = prose(rng, n, 10**6).split()
    q = p.copy()
    for i in [(k + 1) * n // (changed + 1) for k in range(changed)] if even else rng.sample(range(3, n - 3), changed):
        q[i] = f"x{rng.randrange(10**6)}"
    return p, q


def test_passages_with_changed_words(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(100):
        p, q = planted(rng, *[(51, 5, True), (51, 7, True), (51, 6, False), (51, 8, False), (60, 4, True)][k % 5])
        rows += [(2 * k, " ".join([prose(rng, 40, 10**6), *p, prose(rng, 40, 10**6)])), (2 * k + 1, " ".join([prose(rng, 60, 10**6), *q, prose(rng, 30, 10**6)]))]
        want[2 * k + 1] = {i for i, w in enumerate(q, 60) if w in p}
    got = defaultdict(set)
    for r in passages.passages(docs(spark, rows)).collect():
        assert r["earlier_doc_id"] == r["doc_id"] - 1
        got[r["doc_id"]] |= set(range(r["begin_word"], r["end_word"]))
    # brute force knows the words of every copy that stand in the passage
    assert [d for d in want if not want[d] <= got[d]] == []


def test_passages_of_lines_that_stand_elsewhere(spark, monkeypatch):
    rng = random.Random(6)
    lines = [prose(rng, 6, 10**6) for _ in range(9)]
    rows = [(i, f"{prose(rng, 30, 10**6)}\n{x}\n{y}\n{prose(rng, 30, 10**6)}") for i, (x, y) in enumerate(zip(lines, lines[1:]))]
    rows += [(d, "\n".join([prose(rng, 40, 10**6), *lines, prose(rng, 20, 10**6)])) for d in (100, 200, 300)]
    for hot in (passages.HOT, 1):  # whole seeds, then seeds in ranges of ids
        monkeypatch.setattr(passages, "HOT", hot)
        found = [tuple(r)[:5] for r in passages.passages(docs(spark, rows)).collect()]
        assert sorted(found) == [(200, 40, 94, 100, 54), (300, 40, 94, 200, 54)]


def test_passages_of_one_word(spark):
    rng, rows = random.Random(8), []
    for k in range(12):
        line = " ".join([f"v{k}"] * 60 if k % 3 else [f"v{k}", f"u{k}"] * 30)
        rows += [(2 * k + i, f"{prose(rng, 30, 10**6)} {line} {prose(rng, 30, 10**6)}") for i in (0, 1)]
    found = {r["doc_id"]: (r["begin_word"], r["end_word"]) for r in passages.passages(docs(spark, rows)).collect()}
    assert found == {2 * k + 1: (30, 90) for k in range(12)}


def test_passages_of_nothing(spark):
    assert passages.passages(docs(spark, [])).count() == 0
    assert passages.without_passages(docs(spark, [])).count() == 0


def test_decontamination(spark, rows, monkeypatch):
    texts = dict(rows)
    long = " ".join(texts[30].split()[:40]) or "x"
    bench = [(1, long), (2, "one two"), (3, None), (4, ""), (None, long), (2, "one two"), (5, " ".join(texts[50].split()[100:130]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = {}
    for d, t in rows:
        w, hit, items = words_of(t), set(), set()
        for k, x in bench:
            if k is None or not x:
                continue
            v = words_of(x)
            size = min(10, len(v))
            grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    items.add(str(k))
        want[d] = (len(w), hit, sorted(items))
    for size in (decontaminate.SHARD_WORDS, 30, 12):  # one automaton, then several, of items whole and cut
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", size)
        for r in decontaminate.match(docs(spark, rows).drop("match"), b).collect():
            m = r["match"]
            hit = {i for s in m["spans"] for i in range(s["begin"], s["end"])}
            assert (m["n_words"], hit, sorted(m["items"])) == want[r["doc_id"]]
    out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs(spark, rows), b).collect()}
    assert 3 not in out and 4 not in out and 0 in out and 1 in out
    assert words_of(out[50]) == [x for i, x in enumerate(words_of(texts[50])) if i not in want[50][1]]
    assert out[40] == texts[40]
    assert decontaminate.match(docs(spark, []).drop("match"), b).count() == 0
    assert decontaminate.match(docs(spark, rows).drop("match"), b.limit(0)).count() == len(rows)
    with pytest.raises(ValueError, match="match"):
        decontaminate.match(docs(spark, rows), b)


def test_wavelet_shards(spark, rows):
    files = wavelet.write_shards(docs(spark, rows), "byte_bpe_50k.json", 2, limit=500)
    assert files.count() > 4
    got = wavelet.read_documents(files).orderBy("start").collect()
    library = tokens.encoder("byte_bpe_50k.json").library
    order, start = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.read_documents(wavelet.write_shards(docs(spark, []), "byte_bpe_50k.json", 2)).count() == 0


def packed(spark, rows):
    """The pieces, held against the library; the share of padding."""
    got = packing.pack(docs(spark, rows)).collect()
    library = tokens.encoder("word_bpe_49k.json").library
    by_doc, by_sequence, texts = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        texts[d, len(ids)].append(ids)
    assert set(by_doc) == set(texts)
    for k, all_ids in texts.items():
        times = np.zeros(k[1], int)
        for r in by_doc[k]:
            lo, hi = r["start"], r["start"] + r["length"]
            assert r["length"] > 0 and hi <= k[1] and r["ids_crc32"] in {zlib.crc32(x[lo:hi].tobytes()) for x in all_ids}
            times[lo:hi] += 1
        assert (times == len(all_ids)).all()
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return 1 - sum(r["length"] for r in got) / 2048 / len(by_sequence)


def test_packing(spark, rows):
    packed(spark, rows)
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [(1,), (9,), (17,), (1100,), (1, 2, 3, 9, 17, 25), (1500, 1300, 3000), tuple(range(200, 1500, 13))])
def test_packing_leaves_little_padding(spark, sizes):
    rng, total, rows = random.Random(2), 0, []
    while total < 150_000 and len(rows) < 40_000:
        n = sizes[rng.randrange(len(sizes))]
        rows.append((len(rows) if len(rows) % 50 else None, " ".join(["the"] * (n - 1)) if n > 1 else rng.choice(["", None])))
        total += n
    assert packed(spark, rows) < 0.01 + 2048 / total


def test_token_counts(spark, rows):
    library = tokens.encoder("byte_bpe_50k.json").library
    texts = defaultdict(list)
    for d, t in [*rows, (60, "a\n\n\nb\nécole\n")]:
        texts[d].append(t or "")
    got = token_counts.attribute(docs(spark, [*rows, (60, "a\n\n\nb\nécole\n")])).collect()
    for r in got:
        ok = False
        for t in texts[r["doc_id"]]:
            ends, at = [], 0
            for line in t.splitlines(keepends=True) if "\n" in t else [t] if t else []:
                at += len(line)
                ends.append(at)
            counts = [0] * len(ends)
            offsets = library.encode(t, add_special_tokens=False).offsets
            for _, e in offsets:
                counts[next(i for i, x in enumerate(ends) if x >= e)] += 1
            ok |= (r["n_tokens"], list(r["section_ends"]), list(r["section_tokens"])) == (len(offsets), ends, counts)
        assert ok and r["n_sections"] == len(r["section_ends"]) and sum(r["section_tokens"]) == r["n_tokens"]
    assert token_counts.attribute(docs(spark, [])).count() == 0


def test_licenses(spark):
    filler = prose(random.Random(5), 30_000)
    rows = [(1, "x. Released under the MIT license!"), (2, None), (3, ""), (4, "licensed under CC-BY-NC 4.0 and released under the mit license."), (4, "nothing"), (None, "Released under the MIT License.")]
    rows += [(5, f"{filler}\nReleased under the MIT License.\n{filler}"), (6, "Released under the MIT License. " * 3), (1, rows[0][1])]
    got = sorted((str(r["doc_id"]), r["license"], r["begin_char"], r["end_char"], r["coverage"]) for r in licenses.scan(docs(spark, rows)).collect())
    n = len(filler) + 1
    want = [("1", "MIT", 3, 33, 1.0)] * 2 + [("4", "CC-BY-NC-4.0", 0, 27, 1.0), ("4", "MIT", 32, 62, 1.0), ("5", "MIT", n, n + 30, 1.0), *(("6", "MIT", 32 * k, 32 * k + 30, 1.0) for k in range(3)), ("None", "MIT", 0, 30, 1.0)]
    assert got == want
    assert licenses.scan(docs(spark, [])).count() == 0
    # ties: of two names for one text the first stays, a name given twice is reported once; texts without words find nothing
    own = [("b", "alpha beta gamma delta"), ("a", "alpha beta gamma delta"), ("a", "alpha beta gamma delta"), ("none", "...")]
    assert [tuple(r)[:4] for r in licenses.scan(docs(spark, [(1, "x alpha beta gamma delta")]), own).collect()] == [(1, "a", 1, 5)]
    assert licenses.scan(docs(spark, rows), []).count() == 0


def test_html(spark):
    page = "<nav><a href=x>menu</a></nav><article><h1>Title {0}</h1><p>Body text of page {0} &amp; more</p></article><footer>foot</footer>"
    rows = [(i, "u", page.format(i)) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "u", page.format(7)), (3, "u", page.format(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.main_text(pages, html_text.fit(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        i = 7 if r["page_id"] is None else r["page_id"]
        assert r["text"] == ("" if i >= 100 else f"Title {i} Body text of page {i} & more") and r["n_chars"] == len(r["text"])
    assert html_text.main_text(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_language(spark):
    rng = random.Random(12)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["kaksi", "yksi", "kolme", "nelja"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i in range(120) for k in ["aa" if i % 2 else "bb"]]
    rows += [(500, None, "aa"), (501, "123 ...", "bb"), (502, "", None), (None, "kaksi yksi", "bb"), (503, "é", None), (504, "×", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(langid.training_rows(d))
    got = {r["doc_id"]: (r["predicted"]["lang"], r["predicted"]["score"]) for r in langid.predict(d, filters).collect()}
    held = [(i, k) for i, _, k in rows[:120] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i][0] == k and 0.5 < got[i][1] <= 1 for i, k in held)
    assert got[500] == got[501] == got[502] == got[504] == ("und", 0.0) and got[None][0] == "bb" and got[503][0] in words
    # long texts, columns of the operator's own names and extra ones, and repeated rows
    long = " ".join(rng.choice(words["aa"]) for _ in range(60_000))
    e = spark.createDataFrame([(1, long, "x", 1, "y"), (1, long, "x", 1, "y"), (2, "kaksi " * 5, "x", 2, "z")], "doc_id long, text string, lang string, score int, rate string")
    assert sorted((r["doc_id"], r["predicted"]["lang"], r["lang"], r["score"], r["rate"]) for r in langid.predict(e, filters).collect()) == [(1, "aa", "x", 1, "y")] * 2 + [(2, "bb", "x", 2, "z")]
    with pytest.raises(ValueError, match="predicted"):
        langid.predict(e.withColumnRenamed("score", "predicted"), filters)
    nothing = langid.fit(langid.training_rows(d.limit(0)))
    assert {r["predicted"]["lang"] for r in langid.predict(d, nothing).collect()} == {"und"}
    assert langid.predict(d.limit(0), filters).count() == 0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.standard_normal((8, 24))
    rows = [(i, (base[i % 8] + 0.12 * rng.standard_normal(24)).tolist(), int(i % 3)) for i in range(80)]
    rows += [(100, rows[0][1], rows[0][2]), (101, None, 1), (102, [0.0] * 24, 1), (103, [float("nan"), *rows[0][1][1:]], 1), (104, rows[0][1], None), (105, rows[0][1][:5], 0), (106, [*rows[0][1][:23], None], 0), (107, [], 0), (108, (2 * np.array(rows[0][1])).tolist(), rows[0][2])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("x", "id")
    good = {i: (np.array(v), k) for i, v, k in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and k is not None}
    links, root = defaultdict(set), {i: i for i, _, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (x, k) in good.items():
        for b, (y, m) in good.items():
            if a < b and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a].add(b)
                links[b].add(a)
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    assert sum(map(len, links.values())) > 50
    monkeypatch.setattr(near_vectors, "CHUNK", 3)  # every bucket in many blocks
    got = near_vectors.near_vectors(e).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (len(links[i]), top(i), top(i) == i) for i, _, _ in rows}
    assert near_vectors.near_vectors(e.limit(0)).count() == 0
    # in more dimensions signatures pick; single and double precision, repeated ids and columns of the operator's own names
    base = rng.standard_normal((60, 48))
    rows = [(i, (base[i % 60] + (0.04 * rng.standard_normal(48) if i >= 60 else 0)).astype(np.float32 if i % 2 else np.float64).tolist(), 1) for i in range(120)] + [(7, rng.standard_normal(48).tolist(), 1)]
    e = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, raw string, part int")
    want = {i: i % 60 for i in range(120)}
    got = near_vectors.near_vectors(e).collect()
    assert len(got) == 121 and all(r["component_id"] == want[r["vec_id"]] and r["n_links"] == 1 for r in got if r["vec_id"] != 7)
    assert [(r["component_id"], r["n_links"]) for r in got if r["vec_id"] == 7] == [(7, 1)] * 2


def test_components(spark):
    rng = random.Random(14)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == top(x) for x in root)


@pytest.mark.parametrize("page_id", [3, 4, None])
def test_html_learns_from_rows_that_share_an_id(spark, page_id):
    words_ = [f"word{i}" for i in range(40)]
    story = lambda i: " ".join(words_[(i * 7 + j) % 40] for j in range(30))
    rows = [(page_id, None if i % 2 else f"u{i % 5}", f"<nav><a href=q>Home</a> <a href=r>News</a></nav><article><p>{story(i)}</p></article><footer>All rights reserved</footer>") for i in range(1300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert 300 <= len(html_text.training_pages(pages)) <= 1200
    same = spark.createDataFrame(rows[:1] * 1300, pages.schema)
    assert 300 <= len(html_text.training_pages(same)) <= 1200
    assert len(html_text.training_pages(pages, chars=10)) == 4
    got = html_text.main_text(pages, html_text.fit(pages)).collect()
    assert sorted(r["text"] for r in got) == sorted(story(i) for i in range(1300))


def test_html_learns_the_ends_of_long_pages(spark):
    rows = [(i, "u", "<article>" + "".join(f"<p>sentence {j} of story {i}</p>" for j in range(400 + i)) + "</article><div class=comments>" + "<p>nice story indeed</p>" * 200 + "</div>") for i in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages, html_text.fit(pages)).collect()}
    assert all("nice story" not in t and t.count("sentence") == 400 + i for i, t in got.items())
