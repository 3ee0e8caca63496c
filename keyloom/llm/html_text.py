"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element gets features: its tag and its parent's, purposes named in its attributes and
its ancestors', depth, size and text density of its subtree, share of linked text, how it
compares with its siblings, and where it stands in the page. Three boosted ensembles say how
likely it is main text (K), dropped (D), or a frame around both (M). Decoding takes the most
likely labels of the whole tree in which nothing below a dropped element is kept and only
frames may hold main text below unkept parents, so ancestors and descendants never disagree.

The model is trained here on generated pages of many layouts (see ``training_pages``), from a
fixed seed and of bounded number; it sees no row of the table. Null or empty html gives an
empty text; broken markup is read as far as it goes. A page of any length or depth is one row, read in time
that grows with its length. Rows that repeat are extracted each; an empty table gives an empty result; a column named ``text``
is replaced, others stay.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.dom import PURPOSES, Page, parse, text_of
from keyloom.llm.store import table

# Tags that are features of their own.
TAGS = "#page html head body main article section div nav aside header footer p h1 h2 h3 ul ol li title form table tr td blockquote pre figure figcaption button select option label textarea fieldset address dl dd span".split()
_TAG = {t: k for k, t in enumerate(TAGS)}
PAGES, TREES, DEPTH, BINS, RATE, SEED = 700, 40, 4, 32, 0.2, 23
STATES = "KDM"


def by_level(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes of each depth, by one sort."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, depth, first node of each page) of all nodes of the pages, parents before children."""
    sizes = np.array([len(p.tag) for p in pages])
    first = np.cumsum(sizes) - sizes
    n, page = int(sizes.sum()), np.repeat(np.arange(len(pages)), sizes)
    tag = np.fromiter((_TAG.get(t, -1) for p in pages for t in p.tag), np.int64, n)
    parent = np.fromiter((x for p in pages for x in p.parent), np.int64, n) + first[page]
    depth = np.fromiter((x for p in pages for x in p.depth), np.int64, n)
    purpose = np.fromiter((x for p in pages for x in p.purpose), np.int64, n)
    own, linked, marks = (np.fromiter((x for p in pages for x in getattr(p, c)), float, n) for c in ("chars", "linked", "marks"))
    root = np.zeros(n, bool)
    root[first] = True
    before = np.cumsum(own) - own
    total = np.add.reduceat(own, first)[page] if n else own

    levels = by_level(depth)[1:]
    sub = np.c_[own, linked, marks, np.ones(n), (tag == _TAG["p"]).astype(float), (tag == _TAG["li"]).astype(float)]
    for rows in reversed(levels):
        np.add.at(sub, parent[rows], sub[rows])
    above = np.zeros(n, np.int64)  # purposes of ancestors, and in what they stand
    kinds = [_TAG[t] for t in ("nav", "aside", "header", "footer", "article", "main", "form", "head")]
    inside = sum((tag == t).astype(np.int64) << (20 + k) for k, t in enumerate(kinds))
    for rows in levels:
        up = parent[rows]
        above[rows] = above[up] | purpose[up] | inside[up]
    inner = np.flatnonzero(~root)
    kids = np.bincount(parent[inner], minlength=n).astype(float)
    order = np.lexsort((np.arange(n), parent, root))  # children of a parent side by side, in page order
    sib = np.zeros(n)
    place = np.arange(n) - np.searchsorted(np.where(root, n, parent)[order], np.where(root, n, parent)[order])
    sib[order] = place
    sib[first] = 0  # a page is not told by its place among the pages
    left, right = np.zeros(n), np.zeros(n)
    a, b = order[:-1], order[1:]
    same = (parent[a] == parent[b]) & ~root[a] & ~root[b]
    left[b[same]], right[a[same]] = sub[a[same], 0], sub[b[same], 0]
    among = np.where(root, 1, kids[parent])
    chars = sub[:, 0]
    columns = [tag == k for k in range(len(TAGS))]
    columns += [tag[parent] == _TAG[t] for t in ("body", "div", "article", "main", "section", "nav", "li", "ul", "header", "footer", "aside", "form", "#page")]
    columns += [purpose >> k & 1 for k in range(len(PURPOSES))] + [above >> k & 1 for k in range(len(PURPOSES))] + [above >> (20 + k) & 1 for k in range(len(kinds))]
    columns += [
        depth, np.log1p(chars), np.log1p(own), np.log1p(chars / sub[:, 3]), sub[:, 1] / np.maximum(chars, 1), 100 * sub[:, 2] / np.maximum(chars, 1), np.log1p(sub[:, 3]), np.log1p(sub[:, 4]), np.log1p(sub[:, 5]),
        kids, sib, among, (sib + 1) / np.maximum(among, 1), np.log1p(left), np.log1p(right), chars / np.maximum(chars[parent], 1), chars * np.maximum(among, 1) / np.maximum(chars[parent], 1), (before - before[first][page]) / np.maximum(total, 1), chars / np.maximum(total, 1),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1), np.where(root, -1, parent), depth, first


@dataclass
class Trees:
    """An ensemble of full binary trees: split feature and bound of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        flat, width, rows = x.ravel(), x.shape[1], np.arange(len(x), dtype=np.int64) * x.shape[1]
        out = np.full(len(x), self.base, np.float32)
        del width
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (flat[rows + f[at]] > b[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic gradient boosting on feature histograms, level by level."""
    n, width = x.shape
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))[: BINS - 1] for c in x.T]
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T, strict=True)], axis=1)  # bin k: bounds[k-1] < value <= bounds[k]
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    margin = np.full(n, np.log(rate / (1 - rate)))
    base, inner = float(margin[0]), 2**DEPTH - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1), np.float32)
    cell = np.arange(width) * BINS + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(DEPTH):
            start, count = 2**level - 1, 2**level
            index = ((at - start)[:, None] * (width * BINS) + cell).ravel()
            hist = [np.bincount(index, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS) for v in (g, h)]
            gl, hl = (v.cumsum(axis=2) for v in hist)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 10) | (ht - hl < least / 10)] = 0
            for k in range(count):
                best = int(np.argmax(gain[k]))
                f, b = divmod(best, BINS)
                if gain[k].flat[best] > 1e-6 and b < len(bounds[f]):
                    features[t, start + k], cuts[t, start + k] = f, bounds[f][b]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > cuts[t, at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves[t] = RATE * gs / (hs + ridge)
        margin += leaves[t][leaf]
    return Trees(base, features, cuts, leaves)


def decode(log_p: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """State of each node (0 K, 1 D, 2 M) with the greatest sum: below K stand K or D, below D only D, below M any."""
    n = len(log_p)
    best = log_p.astype(float).copy()
    levels = by_level(depth)
    for rows in reversed(levels[1:]):
        k, d, m = best[rows].T
        np.add.at(best, parent[rows], np.stack([np.maximum(k, d), d, np.maximum(np.maximum(k, d), m)], axis=1))
    out = np.zeros(n, np.int64)
    for level, rows in enumerate(levels):
        b = best[rows]
        if level == 0:
            b = b + [0, -np.inf, 0]  # the page itself is main text or a frame
        else:
            up = out[parent[rows]]
            b = np.where((up == 1)[:, None], b + [-np.inf, 0, -np.inf], np.where((up == 0)[:, None], b + [0, 0, -np.inf], b))
        out[rows] = np.argmax(b, axis=1)
    return out


@dataclass
class Model:
    ensembles: tuple[Trees, Trees, Trees]

    def states(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        """(state of each node, first node of each page)."""
        x, parent, depth, first = features(pages)
        p = np.stack([1 / (1 + np.exp(-np.clip(e.margin(x), -12, 12))) for e in self.ensembles], axis=1)
        return decode(np.log(p / p.sum(axis=1, keepdims=True)), parent, depth), first

    def texts(self, htmls: list[str | None]) -> list[str]:
        pages = [parse(h) for h in htmls]
        states, first = self.states(pages)
        keep = (states == 0).tolist()
        return [text_of(p, keep[a : a + len(p.tag)]) for p, a in zip(pages, first.tolist(), strict=True)]


_SYLLABLES = "ka lo mi ter va sun del pra nu esk ior tam bel ro chi und ga fe zot il".split()


def _words(r: random.Random, low: int, high: int) -> str:
    out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))]
    for k in range(r.randint(4, 14), len(out), 12):
        out[k] += r.choice(".,.,;?!")
    return " ".join(out).capitalize() + r.choice(["", ".", "."])


def training_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Generated pages whose elements carry their state in ``data-gold``."""
    r = random.Random(seed)

    def el(tag: str, state: str, inner: str, *names: str) -> str:
        named = ""
        if names and r.random() < 0.75:
            named = f' {r.choice(["class", "class", "id", "role"])}="{r.choice(names)}{r.choice(["", "", " box", "-1"])}"'
        return f'<{tag}{named} data-gold="{state}">{inner}</{tag}>'

    def links(low: int, high: int) -> str:
        items = [f'<a href="/x">{_words(r, 1, 3)}</a>' for _ in range(r.randint(low, high))]
        if r.random() < 0.7:
            return el(r.choice(["ul", "ul", "ol"]), "D", "".join(el("li", "D", x) for x in items))
        return " ".join(items)

    def junk() -> str:
        kind, t = r.randrange(11), r.choice(["div", "div", "section", "aside"])
        short = lambda: el("p", "D", _words(r, 3, 25)) if r.random() < 0.6 else _words(r, 3, 20)
        if kind == 0:
            return el("nav", "D", links(3, 9), "nav", "menu")
        if kind == 1:
            return el(r.choice(["div", "ul"]), "D", "".join(el("li", "D", f'<a href="#">{_words(r, 1, 2)}</a>') for _ in range(r.randint(3, 8))), "menu", "nav", "breadcrumb", "navigation")
        if kind in (2, 3):
            return el(t, "D", short(), "ad", "ads", "advert", "sponsor", "promo banner")
        if kind == 4:
            return el(r.choice(["aside", "aside", "div"]), "D", el("h3", "D", _words(r, 1, 4)) + links(3, 8) + short(), "sidebar", "side", "widget")
        if kind == 5:
            return el("footer" if r.random() < 0.7 else "div", "D", "&copy; " + _words(r, 3, 18) + (links(0, 4) if r.random() < 0.4 else ""), "footer", "foot copyright")
        if kind == 6:
            return el(r.choice(["div", "section"]), "D", el("h3", "D", "Comments") + "".join(el("div", "D", el("p", "D", _words(r, 5, 60)), "comment", "reply") for _ in range(r.randint(1, 6))), "comments", "discussion", "respond")
        if kind == 7:
            return el("div", "D", short() + (el("button", "D", "OK") if r.random() < 0.6 else ""), "cookie", "consent", "notice", "popup", "newsletter")
        if kind == 8:
            return el("form", "D", el("label", "D", _words(r, 1, 3)) + "<input>" + el("button", "D", _words(r, 1, 2)), "search", "login", "form")
        if kind == 9:
            return el("header" if r.random() < 0.7 else "div", "D", el("div", "D", _words(r, 1, 4), "logo") + (el("nav", "D", links(3, 7)) if r.random() < 0.5 else ""), "header", "top", "masthead")
        return el("div", "D", links(3, 6), "related", "share", "social", "tags")

    def article() -> str:
        parts = [el("h1", "K", _words(r, 3, 12))] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.72:
                words = _words(r, *r.choice([(1, 6), (6, 30), (20, 120), (60, 260)]))
                if r.random() < 0.12:
                    words = f"<b>{words}<br>"
                elif r.random() < 0.15:
                    words += f' <a href="/y">{_words(r, 1, 3)}</a> {_words(r, 3, 20)}'
                parts.append(f'<p data-gold="K">{words}' + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.78:
                parts.append(el(r.choice(["h2", "h3"]), "K", _words(r, 1, 8)))
            elif kind < 0.84:
                parts.append(el("ul", "K", "".join(el("li", "K", _words(r, 2, 20)) for _ in range(r.randint(2, 6)))))
            elif kind < 0.88:
                parts.append(el("blockquote", "K", el("p", "K", _words(r, 8, 60))))
            elif kind < 0.91:
                parts.append(el("pre", "K", _words(r, 5, 40)))
            elif kind < 0.94:
                parts.append(el("table", "K", "".join(el("tr", "K", "".join(el("td", "K", _words(r, 1, 4)) for _ in range(3))) for _ in range(3))))
            elif kind < 0.97:
                parts.append(el("section", "K", el("p", "K", _words(r, 20, 120))))
            else:
                parts.append(junk())
        inner = "".join(parts)
        if r.random() < 0.72:
            return el("article", "K", inner, "article", "post", "entry")
        return f'<div class="{r.choice(["article", "post", "entry content", "content", "story", "main text", "post body"])}" data-gold="K">{inner}</div>'

    out = []
    for _ in range(n):
        if r.random() < 0.04:
            out.append(r.choice([_words(r, 20, 200), f'<p data-gold="K">{_words(r, 20, 200)}</p><p data-gold="K">{_words(r, 10, 90)}</p>', article()]) + '<i data-root="K"></i>')
            continue
        body = [junk() for _ in range(r.choice([0, 1, 2, 2, 3]))]
        core = article()
        if r.random() < 0.3:
            core = el(r.choice(["main", "div"]), "M", "".join(junk() for _ in range(r.randint(0, 2))) + core + "".join(junk() for _ in range(r.randint(0, 2))), "main", "content", "page", "container", "wrapper")
        body.append(core)
        body += [junk() for _ in range(r.choice([0, 1, 1, 2, 3]))]
        inner = "".join(body)
        if r.random() < 0.25:
            inner = el("div", "M", inner, "page", "wrapper", "container", "site")
        head = f'<head data-gold="D"><meta charset="utf-8"><title data-gold="D">{_words(r, 3, 12)}</title></head>' if r.random() < 0.9 else ""
        out.append(f'<!DOCTYPE html><html lang="x" data-gold="M">{head}<body data-gold="M">{inner}' + ("</body></html>" if r.random() < 0.85 else ""))
    return out


@lru_cache(maxsize=2)
def train(pages: int = PAGES, seed: int = SEED) -> Model:
    """The model of the generated pages."""
    htmls = training_pages(pages, seed)
    parsed = [parse(h, gold=True) for h in htmls]
    x = features(parsed)[0]
    gold = np.array([STATES.find(g or ("K" if 'data-root="K"' in h else "M")) for h, p in zip(htmls, parsed, strict=True) for g in p.gold])
    return Model(tuple(boost(x, (gold == k).astype(float)) for k in range(3)))


#: Pages whose nodes are scored together.
TOGETHER = 256


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """Every row with all its columns and ``text``, the main text, which replaces any column of that name."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    out = pages.withColumn("text", F.lit("")) if html_col != "text" else pages
    at, to = out.columns.index(html_col), out.columns.index("text")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                columns = list(part.columns)
                columns[to] = pa.array(shared.value.texts(part.column(at).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return out.mapInArrow(run, out.schema)


def op8_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
