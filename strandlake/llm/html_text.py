"""Main text of HTML pages by a recurrent block labeller in numpy.

A page is cut into leaf blocks: runs of text between block-level tags, with inline tags taken out, character
references decoded and white space joined. Tags are read by HTML's rules: unquoted values may hold quotes, a quote that is
never closed ends with its tag, `/>` closes foreign elements only, scripts, styles, titles, text areas and frames are raw
text up to their end tag. What is never shown (comments, drawings, fallback content of embedded objects, lists of
choices, templates) makes no blocks; such an element without an end tag hides nothing. A block is described by the hashed
names, classes, ids and roles on its tag path, its hashed words, its length, its share of link text and its place. A
bidirectional LSTM reads a page's blocks in order, so each is judged with the whole page in view; blocks labelled as main
text are joined by one space. Paths are kept as a tree and their sums are taken from the root down, so time and memory
grow with the page, not with its depth.

The labeller is trained on some SAMPLE pages of at most SAMPLE_CHARS characters (documented bounds; longer ones only if
there are no others), chosen by a hash of page_id, url and html, with labels from rules on tags and class names. In every
epoch it reads all blocks of a page, or TRAIN_BLOCKS in a row of a longer one, from another place each time, so ends of
long pages are learned too. Prediction covers every whole page with the network alone.

Null or empty html, or no block labelled: empty text. Null and repeated page_ids or urls are rows like others; other
columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

SAMPLE = 600
SAMPLE_CHARS = 1 << 18
TRAIN_BLOCKS = 256
EPOCHS = 16
PATHS, WORDS, WIDTH, HIDDEN = 1024, 1024, 12, 12

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""
    # a value is quoted, or free of white space; other quotes are part of names
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+|["'])*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
#: raw text up to its end tag (fixed values)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style title textarea iframe noembed noframes".split()}
#: elements whose content is not shown, of which these are foreign, and the tags that end foreign content (fixed values)
UNSHOWN = frozenset("svg object select template noscript audio video canvas datalist annotation annotation-xml".split())
FOREIGN = frozenset("svg math".split())
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: tags that do not end a block, tags without content, and tags that end one of their kind (fixed values)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt mstyle msub msup mtext nobr q rb rp rt rtc ruby s samp semantics small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "p": {"p"}}
ENDS |= {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: names that mark what is not main text, and what is, for the training labels (fixed values)
OTHER_TAGS = frozenset("nav footer aside form button menu dialog fieldset input".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead "
    "comment comments disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert notification popup modal overlay toast share sharing social related recommend recommended "
    "newsletter subscribe subscription signup login form search pagination pager widget toolbar tags hidden skip legal copyright disclaimer complementary contentinfo".split()
)
MAIN_NAMES = frozenset("article main content post entry story body text".split())

class Element:
    """What one opening tag says: its features, and for training whether its content is main text (1, -1 or 0)."""

    def __init__(self, tag: str, attributes: str):
        self.tag = tag
        plain = set()
        for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            name = name.lower()
            if name == "style":
                plain |= {"hidden"} if re.search(r"display\s*:\s*none", value) else set()
            elif name == "hidden":
                plain.add("hidden")
            elif name in ("class", "id", "role", "itemprop", "aria-label"):
                plain |= {x.lower() for x in _NAME.findall(value)}
        names = pa.array(sorted({f"<{tag}>"} | plain))
        self.features = tuple((words.word_hashes(names, np.ones(256, bool))[0] % np.uint64(PATHS)).tolist())
        self.sign = -1 if tag in OTHER_TAGS or plain & OTHER_NAMES else 1 if tag in ("article", "main") or plain & MAIN_NAMES else 0


_elements: dict[tuple[str, str], Element] = {}


def _element(tag: str, attributes: str) -> Element:
    if len(attributes) > 1000:
        return Element(tag, attributes)
    key = (tag, attributes)
    e = _elements.get(key)
    if e is None:
        if len(_elements) > 20_000:
            _elements.clear()
        e = _elements[key] = Element(tag, attributes)
    return e


class Page:
    """Leaf blocks (text, node, share of link characters, sign of the innermost marked element) and the tree of the
    nodes they stand in: every node's parent, depth and features. Node 0 is the page."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, float, int]] = []
        self.parents, self.depths, self.features = [0], [0], [()]
        self.before = self.after = 0  # blocks of the page that are left out

    def part(self, begin: int, n: int) -> Page:
        """The page with n of its blocks only; these keep their places."""
        out = Page()
        out.blocks, out.parents, out.depths, out.features = self.blocks[begin : begin + n], self.parents, self.depths, self.features
        out.before, out.after = begin, len(self.blocks) - begin - len(out.blocks)
        return out


def tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(begin, end, lower-case name, whether it ends an element, attributes) of all tags; comments and raw-text elements
    are one without a name."""
    out, at, foreign = [], 0, 0
    while m := _TOKEN.search(page, at):
        at, name = m.end(), m.group(2)
        if name is None:
            out.append((m.start(), at, "", False, ""))
            continue
        name, ends, attributes = name.lower(), bool(m.group(1)), m.group(3)
        if name in FOREIGN and not attributes.endswith("/"):
            foreign = max(0, foreign + (-1 if ends else 1))
        if name in RAW and not ends and not (foreign and attributes.endswith("/")):
            close = RAW[name].search(page, at)
            at = close.end() if close else len(page)
            name = ""
        out.append((m.start(), at, name, ends, attributes))
    return out


def unshown(found: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """For tags that begin what is not shown, the number of the tag that ends it; elements without an end are left out."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, (_, _, name, ends, attributes) in enumerate(found):
        if name in UNSHOWN:
            mine = open_.setdefault(name, [])
            if not ends:
                if not (name == "svg" and attributes.endswith("/")):
                    mine.append(i)
            elif mine:
                out[mine.pop()] = i
        elif name in LEAVES and open_.get("svg"):
            for k in open_.pop("svg"):
                out[k] = i - 1
    return out


def blocks(page: str) -> Page:
    """The leaf blocks of a page."""
    out = Page()
    # of each open element: tag, node, whether it or one around it is no main text, is main text, a header, an article
    stack: list[tuple[str, int, bool, bool, bool, bool]] = [("", 0, False, False, False, False)]
    open_: dict[str, int] = {}
    text: list[str] = []
    linked = inside = at = 0

    def close() -> None:
        nonlocal text, linked
        if text:
            joined = "".join(text)
            shown = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if shown:
                _, node, other, main, header, article = stack[-1]
                # a header is page furniture unless it stands in an article
                sign = -1 if other or header and not article else 1 if main else 0
                out.blocks.append((shown, node, min(1.0, linked / max(1, len(joined))), sign))
            text, linked = [], 0

    found = tags(page)
    hidden, until = unshown(found), -1
    for i, (begin, end, tag, ends, attributes) in enumerate(found):
        if i > until:
            if begin > at:
                text.append(page[at:begin])
                if inside:
                    linked += begin - at
            until = hidden.get(i, -1)
        at = end
        if i <= until or tag in ("", "head", *UNSHOWN):
            continue
        if tag in INLINE:
            if tag == "a":
                inside = 0 if ends else 1
            continue
        if tag == "br":
            text.append("\n")
            continue
        close()
        if tag in VOID:
            continue
        if ends:
            if open_.get(tag):
                while True:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == tag:
                        break
        else:
            implied = ENDS.get(tag, ())
            while stack[-1][0] in implied:
                open_[stack.pop()[0]] -= 1
            e, (_, node, other, main, header, article) = _element(tag, attributes), stack[-1]
            out.parents.append(node)
            out.depths.append(len(stack))
            out.features.append(e.features)
            stack.append((tag, len(out.parents) - 1, other or e.sign < 0, main or e.sign > 0, header or tag == "header", article or tag in ("article", "main")))
            open_[tag] = open_.get(tag, 0) + 1
    if at < len(page):
        text.append(page[at:])
        linked += (len(page) - at) * inside
    close()
    return out


def labels(page: Page) -> np.ndarray:
    """Training labels: marked elements decide; pages without a marked main part: longer texts with few links."""
    some = any(b[3] == 1 for b in page.blocks)
    return np.array([b[3] == 1 if some else b[3] == 0 and b[2] < 0.4 and len(b[0]) >= 25 for b in page.blocks], np.float32)


def _sums(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(sizes), table.shape[1]), table.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        sums[some] = np.add.reduceat(table[ids], starts, axis=0)
    return sums


class Features:
    """Sparse and dense inputs of a list of pages' blocks in a row."""

    def __init__(self, pages: list[Page]):
        flat = [b for p in pages for b in p.blocks]
        self.pages = np.array([len(p.blocks) for p in pages], np.int64)
        h, first = words.word_hashes(pa.array([b[0] for b in flat], pa.string()), words.LETTER_WORDS)
        self.word_ids, self.word_sizes = (h % np.uint64(WORDS)).astype(np.int64), np.diff(first)
        trees = np.array([len(p.parents) for p in pages], np.int64)
        shift = np.cumsum(trees) - trees
        self.parents = np.array([x for p in pages for x in p.parents], np.int64) + np.repeat(shift, trees)
        self.nodes = np.array([b[1] for b in flat], np.int64) + np.repeat(shift, self.pages)
        own = [f for p in pages for f in p.features]
        self.path_sizes, self.path_ids = np.array([len(f) for f in own], np.int64), np.array([x for f in own for x in f], np.int64)
        depths = np.array([x for p in pages for x in p.depths], np.int64)
        order = np.argsort(depths, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depths[order])) + 1)[1:] if len(order) else []
        lengths = self.path_sizes.astype(np.float32)[:, None]
        self.path_lengths = np.maximum(1, self.down(lengths)[self.nodes])
        where = np.concatenate([np.linspace(0, 1, p.before + len(p.blocks) + p.after)[p.before : p.before + len(p.blocks)] for p in pages]) if len(flat) else np.zeros(0)
        self.dense = np.stack([np.log1p(self.word_sizes) / 4, [b[2] for b in flat], where, np.ones(len(flat))], 1).astype(np.float32) if flat else np.zeros((0, 4), np.float32)

    def down(self, x: np.ndarray) -> np.ndarray:
        """Sums of every node's row and those of all nodes around it."""
        x = x.copy()
        for level in self.levels:
            x[level] += x[self.parents[level]]
        return x

    def up(self, x: np.ndarray) -> np.ndarray:
        """Sums of every node's row and those of all nodes within it."""
        x = x.copy()
        for level in reversed(self.levels):
            np.add.at(x, self.parents[level], x[level])
        return x


class Labeller:
    """Bidirectional LSTM over the blocks of a page, with trained tables for path and word features."""

    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        size = 2 * WIDTH + 4
        init = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.p = {"paths": init(PATHS, WIDTH), "words": init(WORDS, WIDTH), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(size, 4 * HIDDEN), f"h{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, HIDDEN) of one direction, and with `keep` what training needs; mask is 0 after a
        page's end."""
        n = x.shape[1]
        h = c = np.zeros((n, HIDDEN), np.float32)
        states, memory = np.zeros((len(x), n, HIDDEN), np.float32), []
        gates_x = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = gates_x[t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                memory.append((t, i, f, o, g, c, tanh, h, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            states[t] = h
        return states, memory

    def _unread(self, dstates: np.ndarray, x: np.ndarray, memory: list, d: str, grads: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, i, f, o, g, c, tanh, h, m in reversed(memory):
            dh = dh + dstates[t]
            dnew = m * dc + m * dh * o * (1 - tanh * tanh)
            dz = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * tanh * o * (1 - o), dnew * i * (1 - g * g)), 1)
            grads[f"h{d}"] += h.T @ dz
            grads[f"x{d}"] += x[t].T @ dz
            grads[f"c{d}"] += dz.sum(0)
            dx[t] = dz @ self.p[f"x{d}"].T
            dh = dz @ self.p[f"h{d}"].T + (1 - m) * dh
            dc = dnew * f + (1 - m) * dc
        return dx

    def inputs(self, f: Features) -> np.ndarray:
        paths = f.down(_sums(f.path_ids, f.path_sizes, self.p["paths"]))[f.nodes] / f.path_lengths
        return np.concatenate((paths, _sums(f.word_ids, f.word_sizes, self.p["words"]) / np.maximum(1, f.word_sizes).astype(np.float32)[:, None], f.dense), 1)

    @staticmethod
    def _padded(x: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        time = np.concatenate([np.arange(n) for n in pages])
        page = np.repeat(np.arange(len(pages)), pages)
        wide = np.zeros((int(pages.max()), len(pages), x.shape[1]), np.float32)
        wide[time, page] = x
        return wide, (np.arange(int(pages.max()))[:, None] < pages).astype(np.float32), time, page

    def scores(self, f: Features, rows: int = 1 << 16) -> np.ndarray:
        """Log odds of main text for every block; pages of like length are read together, `rows` cells at a time."""
        out = np.zeros(int(f.pages.sum()), np.float32)
        x, starts = self.inputs(f), np.cumsum(f.pages) - f.pages
        order = [i for i in np.argsort(f.pages, kind="stable").tolist() if f.pages[i]]
        while order:
            n = max(1, min(len(order), rows // int(f.pages[order[-1]])))
            some, order = np.array(order[-n:]), order[:-n]
            at = np.concatenate([np.arange(starts[i], starts[i] + f.pages[i]) for i in some])
            wide, mask, time, page = self._padded(x[at], f.pages[some])
            both = np.concatenate([self._read(wide, mask, d)[0] for d in "fb"], 2)
            out[at] = (both @ self.p["out"] + self.p["bias"])[time, page]
        return out

    def step(self, f: Features, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        x = self.inputs(f)
        wide, mask, time, page = self._padded(x, f.pages)
        read = {d: self._read(wide, mask, d, True) for d in "fb"}
        both = np.concatenate([read[d][0] for d in "fb"], 2)
        z = (both @ self.p["out"] + self.p["bias"])[time, page]
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grads["out"], grads["bias"] = both[time, page].T @ dz, np.array([dz.sum()], np.float32)
        dboth = np.zeros_like(both)
        dboth[time, page] = dz[:, None] * self.p["out"]
        dwide = sum(self._unread(dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN], wide, read[d][1], d, grads) for k, d in enumerate("fb"))
        dx = dwide[time, page]
        nodes = np.zeros((len(f.parents), WIDTH), dx.dtype)
        np.add.at(nodes, f.nodes, dx[:, :WIDTH] / f.path_lengths)
        np.add.at(grads["paths"], f.path_ids, np.repeat(f.up(nodes), f.path_sizes, 0))
        np.add.at(grads["words"], f.word_ids, np.repeat(dx[:, WIDTH : 2 * WIDTH] / np.maximum(1, f.word_sizes)[:, None], f.word_sizes, 0))
        return grads

    def train(self, pages: list[Page], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.02, seed: int = 6) -> None:
        pages = [p for p in pages if p.blocks]
        signs = [labels(p) for p in pages]
        rng, places = (np.random.Generator(np.random.PCG64(s)) for s in (seed, seed + 1))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        n = 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs)
            order = rng.permutation(len(pages))
            for k in range(0, len(order), batch):
                some, y = [], []
                for i in order[k : k + batch]:
                    over = len(pages[i].blocks) - TRAIN_BLOCKS
                    begin = int(places.integers(over + 1)) if over > 0 else 0
                    some.append(pages[i].part(begin, TRAIN_BLOCKS))
                    y.append(signs[i][begin : begin + TRAIN_BLOCKS])
                n += 1
                for name, g in self.step(Features(some), np.concatenate(y)).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= pace * (m[name] / (1 - 0.9**n)) / (np.sqrt(v[name] / (1 - 0.99**n)) + 1e-6)


def training_pages(pages: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """Html of about `sample` rows, at most twice as many, of at most `chars` characters each.

    Rows are chosen by a hash of all that tells them apart. Where too few fall under its bound, as among many equal rows,
    those of the least hashes are taken, so there are min(sample, n) / 2 of n rows at least. Where every page is longer,
    a few of the shortest pages are taken whole.
    """
    text = pages.select(*[pages[c].cast("string").alias(c) for c in ("page_id", "url", "html")]).where("html is not null and html <> ''")
    rows = text.select("html", F.xxhash64("page_id", "url", "html", F.lit("train")).alias("h")).where(F.length("html") <= chars)
    n = rows.count()
    if not n:
        return [r[0] for r in text.select("html").orderBy(F.length("html"), "html").limit(4).collect()]
    under = F.pmod("h", F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / n)))
    chosen = rows.where(under).orderBy("h", "html").limit(2 * sample).select("html").collect()
    if 2 * len(chosen) < min(sample, n):
        chosen = rows.orderBy("h", "html").limit(sample).select("html").collect()
    return [r[0] for r in chosen]


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller trained on the rows of training_pages()."""
    out = Labeller()
    out.train([blocks(p) for p in training_pages(pages, sample)])
    return out


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    common.small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(labeller)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for b in words.pieces(batch, "html"):
                cut = [blocks(p or "") for p in b.column(2).to_pylist()]
                f = Features(cut)
                keep = (net.scores(f) > 0).tolist() if len(f.dense) else []
                texts, at = [], 0
                for p in cut:
                    texts.append(" ".join(x[0] for x, k in zip(p.blocks, keep[at : at + len(p.blocks)]) if k))
                    at += len(p.blocks)
                text = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pc.utf8_length(text).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, fit(pages))
