"""HTML pages as flat trees: one row per element that can be kept or dropped, texts in page order."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

# Elements that do not break a line.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math noscript object q s samp small span strike strong sub sup svg time tt u var wbr".split())
# Elements without an end tag, those whose content is no markup, those whose content is never text, and those in which nothing breaks a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
HIDDEN = ("template", "iframe")
FOREIGN = ("math", "svg")
# Start tags that end an open paragraph, and elements ended by the next of their kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset(("ul", "ol", "dl", "table", "tr", "select", "body", "html", "article", "section", "div", "aside", "nav", "main"))

# Words in class, id and role that tell what an element is for, by purpose.
PURPOSES = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar",
    "side": "side sidebar aside rail widget widgets column secondary complementary",
    "foot": "foot footer copyright contentinfo legal bottom colophon",
    "head": "head header masthead topbar logo branding top site",
    "reply": "comment comments reply replies respond discussion disqus thread",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe paywall",
    "share": "share sharing social related recommended popular trending more tags meta",
    "form": "form search login signup contact input",
    "main": "article content post entry main body story text page container",
}
_PURPOSE_OF = {w: 1 << k for k, words in enumerate(PURPOSES.values()) for w in words.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_GOLD = re.compile(r'data-gold="(\w)"')
_PUNCTUATION = re.compile(r"[.,;:!?]")

_purposes: dict[str, int] = {"": 0}


def purposes_of(attributes: str) -> int:
    """Bits of the purposes named in the attributes, and the top bit if any class, id or role is there at all."""
    found = _purposes.get(attributes)
    if found is None:
        found = 0
        for m in _NAMES.finditer(attributes):
            found |= 1 << 10
            for w in _WORDS.findall(m[1] or m[2] or m[3] or ""):
                found |= _PURPOSE_OF.get(w.lower(), 0)
        if len(_purposes) < 20_000:  # a cache, cleared never and so bounded
            _purposes[attributes] = found
    return found


@dataclass
class Page:
    """Node 0 stands for the page. pieces: (node, text) in page order, (-1, "") where a block ends."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    purpose: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])
    gold: list[str] = field(default_factory=lambda: [""])
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str | None, gold: bool = False) -> Page:
    """The page's tree; broken markup never fails, an unclosed element ends with its parent."""
    page = Page()
    if not html:
        return page
    pieces, chars, linked, marks = page.pieces, page.chars, page.linked, page.marks
    open_: list[tuple[str, int, bool]] = [("#page", 0, True)]  # name, node, breaks a line
    # Where in open_ the elements of each name stand, and the last scopes (of any kind, and other than rows): so that an end tag
    # or an element that ends others looks nothing up by walking through what is open.
    where: dict[str, list[int]] = {}
    scopes, no_rows = [0], [0]
    links, at, n, hidden, foreign = 0, 0, len(html), False, False

    def text(a: int, b: int) -> None:
        if hidden and any(where.get(x) for x in HIDDEN):
            return
        s = html[a:b]
        if "&" in s:
            s = _html.unescape(s)
        node = open_[-1][1]
        pieces.append((node, s))
        if k := len(s.strip()):
            chars[node] += k
            linked[node] += k * (links > 0)
            marks[node] += len(_PUNCTUATION.findall(s))

    def close(to: int) -> None:
        nonlocal links
        for name, _, breaks in open_[to:]:
            links -= name == "a"
            where[name].pop()
            if breaks:
                pieces.append((-1, ""))
        del open_[to:]
        for stack in (scopes, no_rows):
            while stack[-1] >= to:
                stack.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=0)

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(at, n)
            break
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if k := last((name,)):
                close(k)
            continue
        attributes = (m[3] if m[2] else m[6]) or ""
        if name in RAW:
            if not attributes.endswith("/"):
                end = _RAW_END[name].search(html, at)  # without an end tag, to the end of the page
                at = end.end() if end else n
            continue
        if name == "br":
            pieces.append((open_[-1][1], " "))
            continue
        if name in ENDS_P:
            if (k := last(("p",))) > scopes[-1]:
                close(k)
        elif name == "tr":
            while (k := last(NEXT["tr"])) > no_rows[-1]:
                close(k)
        elif name in NEXT and (k := last(NEXT[name])) > scopes[-1]:
            close(k)
        if name in VOID:
            if name not in INLINE:
                pieces.append((-1, ""))
            continue
        hidden, foreign = hidden or name in HIDDEN, foreign or name in FOREIGN
        breaks = name not in INLINE and not (foreign and any(where.get(x) for x in FOREIGN))
        purpose, node = purposes_of(attributes), open_[-1][1]
        if breaks:
            pieces.append((-1, ""))
        if breaks or purpose or name == "noscript":  # which is judged by itself
            page.parent.append(node)
            page.depth.append(page.depth[node] + 1)
            node = len(page.tag)
            page.tag.append(name)
            page.purpose.append(purpose)
            chars.append(0)
            linked.append(0)
            marks.append(0)
            if gold:
                page.gold.append(m[1] if (m := _GOLD.search(attributes)) else "")
        links += name == "a"
        where.setdefault(name, []).append(len(open_))
        if name in SCOPE:
            scopes.append(len(open_))
            if name != "tr":
                no_rows.append(len(open_))
        open_.append((name, node, breaks))
    return page


def text_of(page: Page, keep: list[bool]) -> str:
    """Text of the kept nodes: white space inside a block is one space, blocks are joined by line feeds."""
    out, now = [], []
    for node, s in page.pieces:
        if node < 0:
            if now:
                if t := " ".join("".join(now).split()):
                    out.append(t)
                now = []
        elif keep[node]:
            now.append(s)
    if now and (t := " ".join("".join(now).split())):
        out.append(t)
    return "\n".join(out)
