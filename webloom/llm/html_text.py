"""Main text of HTML pages: gradient-boosted trees over DOM-node features, decoded over the tree.

A page becomes a tree of its elements; text that lies in an element beside child elements gets a node of its own, and so do
inline elements whose attributes tell something. Each node that holds text gets features of its subtree's density, the tokens of its
attributes and its ancestors', its depth and its siblings, and boosted trees estimate whether its subtree holds main text.
Decoding chooses the most likely labelling in which everything below a rejected element is rejected, so ancestors and
descendants can't contradict each other. The trees are fitted to pages that this module makes, with many layouts.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order by
one newline; nothing else is dropped or cut. Null, empty and textless html give the empty string. Markup may be broken:
stray end tags are ignored, open elements end with the page,
a tag that the page's end cuts off is dropped. The work on a page follows its length. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from math import log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg math object audio video canvas select title xmp noembed".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLING_ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tbody": ("tbody thead tfoot tr td th", {"table"}), "thead": ("tbody thead tfoot tr td th", {"table"}), "tfoot": ("tbody thead tfoot tr td th", {"table"}), "option": ("option", {"select"})}
_SIBLING_ENDS = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _SIBLING_ENDS.items()}

_TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h", "li", "list", "table", "cell", "quote", "pre", "figure", "body", "text", "inline", "other"]
_TAG_CODE = {t: i for i, t in enumerate(_TAGS)} | {f"h{k}": _TAGS.index("h") for k in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), _TAGS.index("list")) | dict.fromkeys(("dt", "dd"), _TAGS.index("li")) | dict.fromkeys(("td", "th"), _TAGS.index("cell")) | dict.fromkeys(("tbody", "thead", "tr"), _TAGS.index("table")) | {"blockquote": _TAGS.index("quote"), "figcaption": _TAGS.index("figure"), "html": _TAGS.index("body"), "#text": _TAGS.index("text")} | dict.fromkeys(_INLINE, _TAGS.index("inline"))

_CUES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topbar toolbar pagination pager tabs skip toc",
    "frame": "header masthead footer colophon copyright legal bottom logo brand site",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending latest more teaser teasers archive tags tagcloud column secondary complementary links",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner dfp adsense commercial outbrain taboola partner affiliate",
    "notice": "cookie cookies consent gdpr notice notification alert alertdialog popup modal overlay dialog paywall newsletter subscribe subscription signup banner",
    "talk": "comment comments commentlist disqus discussion respond reply replies feedback thread reader reactions review reviews responses conversation",
    "share": "share sharing social follow facebook twitter email print like likes byline meta author bio",
    "form": "form login search signin register contact input field",
    "good": "article post entry story content contents body main text page blog news copy prose hentry paragraph",
}
_CUE_BIT = {}
for _k, (_name, _tokens) in enumerate(_CUES.items()):
    for _t in _tokens.split():
        _CUE_BIT[_t] = _CUE_BIT.get(_t, 0) | 1 << _k
_GOOD = 1 << list(_CUES).index("good")
_TAG_BITS = {"nav": 1, "header": 2, "footer": 2, "aside": 4, "form": 1 << list(_CUES).index("form"), "article": _GOOD, "main": _GOOD}
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


#: For each tag that ends others of its kind: the tags that it ends, up to the nearest of the second.
_WATCHED = {t: [k for k, (ends, limits) in _SIBLING_ENDS.items() if t in ends or t in limits] for t in {x for ends, limits in _SIBLING_ENDS.values() for x in ends | limits}}
_CELLS = frozenset(("td", "th", "table"))


@dataclass
class Tree:
    """Nodes in page order: parents before children. blocks: (node, text, pieces) in page order; pieces are None, or (node, text) of the parts of a block in which inline nodes lie. Blocks of inline nodes have no pieces and are not printed by themselves (shown)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    blocks: list[tuple[int, str, list[tuple[int, str]] | None]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    shown: list[bool] = field(default_factory=list)


def _cues(attrs: str) -> int:
    bits = 0
    for _, a, b, c in _ATTR.findall(attrs):
        for w in _WORD.findall(a or b or c):
            bits |= _CUE_BIT.get(w.lower(), 0)
    return bits


def _text(pieces) -> str:
    return " ".join("".join(pieces).split())


def parse(source: str) -> Tree:
    """The tree of a page. Inline elements without telling attributes have no node; their text belongs to the block around them."""
    tags, parents, bits, marks, begins = ["html"], [-1], [0], [""], [-1]
    found: list[tuple[int, int, list[tuple[int, str, bool]]]] = []  # place, block element, (node, text, whether in a link)
    # Open elements: node or -1, tag, and the block element, its place in the stack and the node before it.
    stack: list[tuple[int, str, int, int, int]] = [(0, "html", 0, 0, 0)]
    block, block_at, current, in_link = 0, 0, 0, 0
    text: list[tuple[int, str, bool]] = []
    opened: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]  # open inline tags, by table cell
    watched: dict[str, list[int]] = {k: [] for k in _SIBLING_ENDS}  # places in the stack
    endless: set[str] = set()
    at, n_source = 0, len(source)

    def flush():
        nonlocal text
        if text:
            found.append((at, block, text))
            text = []

    def say(piece: str):
        if piece:
            text.append((current, _html.unescape(piece) if "&" in piece else piece, in_link > 0))

    def push(node: int, name: str):
        nonlocal block, block_at, current
        for k in _WATCHED.get(name, ()):
            watched[k].append(len(stack))
        stack.append((node, name, block, block_at, current))
        opened[name] = opened.get(name, 0) + 1
        if name in _INLINE:
            scopes[-1][name] = scopes[-1].get(name, 0) + 1
        else:
            block, block_at = node, len(stack) - 1
            if name in _CELLS:
                scopes.append({})
        if node >= 0:
            current = node

    def pop_to(k: int):
        """Close the elements from the stack's place k on."""
        nonlocal block, block_at, current, in_link
        while len(stack) > k:
            node, name, b, b_at, c = stack[-1]
            if name not in _INLINE:
                flush()
                if name in _CELLS:
                    scopes.pop()
            else:
                scopes[-1][name] -= 1
                if name == "a":
                    in_link -= 1
            stack.pop()
            for key in _WATCHED.get(name, ()):
                watched[key].pop()
            opened[name] -= 1
            block, block_at, current = b, b_at, c

    def node_of(name: str, attrs: str, cues: int) -> int:
        tags.append(name), parents.append(current), bits.append(cues | _TAG_BITS.get(name, 0)), marks.append(attrs), begins.append(at)
        return len(tags) - 1

    while at < n_source:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            at = n_source
            break
        say(source[at : m.start()])
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if name in ("html", "body") or not (scopes[-1] if name in _INLINE else opened).get(name):
                continue
            k = len(stack) - 1
            while stack[k][1] != name:
                k -= 1
            pop_to(k)
            continue
        if name in _RAW or name == "head":
            if name == "head":
                e = None if name in endless else re.compile(r"</head\s*>|<body\b", re.I).search(source, at)
                if e is None:
                    endless.add(name)
                else:
                    at = e.end() if source[e.start() + 1] == "/" else e.start()
                continue
            if attrs.endswith("/") and name in ("svg", "math"):
                continue
            e = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(source, at)
            if e is not None:
                at = e.end()
            elif name in ("title", "select", "object", "audio", "video", "canvas", "svg", "math"):
                endless.add(name)
            else:
                at = n_source
            continue
        if name in _VOID:
            if name == "br":
                text.append((current, " ", False))
            elif name == "hr":
                flush()
            continue
        cues = _cues(attrs) if attrs else 0
        if name in _INLINE:
            if name == "a":
                in_link += 1
            push(node_of(name, attrs, cues) if cues & ~_GOOD else -1, name)
            continue
        if name in ("html", "body"):
            bits[0] |= cues & ~_GOOD
            continue
        if name in _CLOSES_P and stack[block_at][1] == "p":
            pop_to(block_at)
        if name in _SIBLING_ENDS:
            ends, places, cut = _SIBLING_ENDS[name][0], watched[name], 0
            for k in reversed(places):
                if stack[k][1] not in ends:
                    break
                cut = k
            if cut:
                pop_to(cut)
        flush()
        push(node_of(name, attrs, cues), name)
    flush()
    return _tree(tags, parents, bits, marks, begins, found)


def _tree(tags, parents, bits, marks, begins, found) -> Tree:
    """Give text that lies beside child elements a node of its own, and bring all nodes into page order."""
    inline = [t in _INLINE for t in tags]
    mixed = [False] * len(tags)
    for e in range(1, len(tags)):
        if not inline[e]:
            p = parents[e]
            while not mixed[p]:
                mixed[p] = True
                p = parents[p] if inline[p] else p
    rows = []  # block, pieces
    for at, e, pieces in found:
        own = e
        if mixed[e] and any(x.strip() for _, x, _ in pieces):
            tags.append("#text"), parents.append(e), bits.append(0), marks.append(marks[e]), begins.append(at), inline.append(False)
            own = len(tags) - 1
        rows.append((e, own, pieces))
    # Before what the same place opens.
    order = sorted(range(len(tags)), key=lambda i: (begins[i], tags[i] != "#text", i))
    place = [0] * len(tags)
    for i, e in enumerate(order):
        place[e] = i
    t = Tree([tags[e] for e in order], [place[parents[e]] if e else -1 for e in order], [bits[e] for e in order], [marks[e] for e in order])
    for e, own, pieces in rows:
        within = any(n != e for n, _, _ in pieces)
        groups: dict[int, list[tuple[str, bool]]] = {}
        for n, x, link in pieces:
            groups.setdefault(own if n == e else n, []).append((x, link))
        if within or own in groups:
            groups.setdefault(own, [])
        for n, parts in sorted(groups.items(), key=lambda g: g[0] != own):
            s = _text(x for x, _ in parts)
            if s or (within and n == own):
                t.blocks.append((place[n], s, [(place[own if k == e else k], x) for k, x, _ in pieces] if within and n == own else None))
                t.linked.append(min(sum(len(x) for x, link in parts if link), len(s)))
                t.shown.append(n == own)
    return t


N_FEATURES = len(_TAGS) + 2 * len(_CUES) + 20


def node_features(t: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(elements that hold text, in page order; their features)."""
    n = len(t.tag)
    chars, links, count, sentences, inner, paragraphs, longest = ([0] * n for _ in range(7))
    first = [-1] * n
    for k, ((e, s, _), a) in enumerate(zip(t.blocks, t.linked, strict=True)):
        if not s:
            continue
        chars[e] += len(s)
        links[e] += a
        count[e] += 1
        sentences[e] += len(_SENTENCE.findall(s))
        longest[e] = max(longest[e], len(s))
        if first[e] < 0:
            first[e] = k
        if t.tag[e] == "p":
            paragraphs[e] += len(s)
    own = list(chars)
    children = [0] * n
    for e in range(n - 1, 0, -1):
        p = t.parent[e]
        chars[p] += chars[e]
        links[p] += links[e]
        count[p] += count[e]
        sentences[p] += sentences[e]
        paragraphs[p] += paragraphs[e]
        inner[p] += inner[e] + 1
        longest[p] = max(longest[p], longest[e])
        if chars[e]:
            children[p] += 1
            if first[p] < 0 or 0 <= first[e] < first[p]:
                first[p] = first[e]
    depth, above, place, before = [0] * n, [0] * n, [0] * n, [0] * n
    seen_kids, seen_chars = [0] * n, [0] * n
    best_child = [0] * n
    total, blocks = max(1, chars[0]), max(1, count[0])
    for e in range(1, n):
        p = t.parent[e]
        depth[e] = depth[p] + 1
        above[e] = above[p] | t.bits[p]
        if chars[e]:
            place[e] = seen_kids[p]
            seen_kids[p] += 1
            before[e] = seen_chars[p]
            seen_chars[p] += chars[e]
            best_child[p] = max(best_child[p], chars[e])
    rows = [e for e in range(n) if chars[e]]
    x = np.zeros((len(rows), N_FEATURES))
    k0 = len(_TAGS)
    k1 = k0 + len(_CUES)
    k2 = k1 + len(_CUES)
    other = len(_TAGS) - 1
    numbers = []
    tag_code = np.empty(len(rows), np.int64)
    own_bits, up_bits = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for i, e in enumerate(rows):
        c = chars[e]
        p = max(t.parent[e], 0)
        tag_code[i] = _TAG_CODE.get(t.tag[e], other)
        own_bits[i], up_bits[i] = t.bits[e], above[e]
        numbers.append((log1p(c), links[e] / c, log1p(count[e]), c / count[e], sentences[e] / count[e], sentences[e] * 100 / c, paragraphs[e] / c, log1p(inner[e]), inner[e] * 100 / c, own[e] / c, depth[e], place[e], children[p], place[e] / max(1, children[p]), c / total, first[e] / blocks, c / max(1, chars[p]), c / max(1, best_child[p]), log1p(longest[e]), (before[e] + 1) / (chars[p] + 1)))
    if rows:
        x[np.arange(len(rows)), tag_code] = 1
        for k in range(len(_CUES)):
            x[:, k0 + k] = own_bits >> k & 1
            x[:, k1 + k] = up_bits >> k & 1
        x[:, k2:] = numbers
    return np.array(rows, np.int64), x


def decode(t: Tree, rows: np.ndarray, z: np.ndarray) -> list[bool]:
    """For each element, whether it is kept: the likeliest labels by log-odds z under which no element below a rejected one is kept."""
    n = len(t.tag)
    keep, reject = [0.0] * n, [0.0] * n
    yes = (-np.logaddexp(0, -z)).tolist()
    no = (-np.logaddexp(0, z)).tolist()
    for e, a, b in zip(rows.tolist(), yes, no, strict=True):
        keep[e], reject[e] = a, b
    best = [False] * n
    for e in range(n - 1, -1, -1):  # children come after their parents: both sums are complete here
        best[e] = keep[e] >= reject[e]
        p = t.parent[e]
        if p >= 0:
            keep[p] += max(keep[e], reject[e])
            reject[p] += reject[e]
    for e in range(1, n):
        best[e] = best[e] and best[t.parent[e]]
    return best


def text_of(t: Tree, kept: list[bool]) -> str:
    """The kept blocks, without inline nodes that aren't kept; of a page without elements, its text."""
    bare = len(t.tag) == 1
    out = []
    for (e, s, pieces), shown in zip(t.blocks, t.shown, strict=True):
        if shown and pieces:
            s = _text(x for n, x in pieces if kept[n])
        if shown and s and (kept[e] or pieces or bare):
            out.append(s)
    return "\n".join(out)


# Pages to learn from.


def _page(r: np.random.Generator) -> str:
    """A made page; elements whose own text is main text carry data-main."""
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    chance = lambda p: r.random() < p
    syllables = "an be con der el fi gu hin ist jo ka lem mo nu or pel qua ri so ter un ver wil zen th on ed ing er ou é ü ción".split()
    word = lambda: "".join(pick(*syllables) for _ in range(int(r.integers(1, 4))))

    def phrase(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(int(r.integers(lo, hi)))).capitalize()

    def prose(lo: int = 1, hi: int = 6) -> str:
        return " ".join(phrase(2, 22) + pick(".", ".", ".", "!", "?") for _ in range(int(r.integers(lo, hi))))

    anchor = lambda lo=1, hi=4: f'<a href="/{word()}">{phrase(lo, hi)}</a>'
    links = lambda k: pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{anchor()}</li>" for _ in range(k)))
    row = lambda k: pick(" | ", " ", " &middot; ").join(anchor() for _ in range(k))
    box = lambda names, inner, tag="div": f'<{tag} {pick("class", "class", "id")}="{pick(*names)}">{inner}</{tag}>'
    main = ' data-main="1"'

    def within(p: str) -> str:
        """A paragraph's text, at times with an inline element in it: a plain or marked part of it, or an advert."""
        k = r.random()
        if k < 0.06:
            return p + f' <{pick("span", "em", "b", "a")} class="{pick("highlight", "date", "text-bold", "term", "link more-info", "footer-ref")}"{main}>{phrase(1, 5)}</{pick("span", "em", "b", "a")}> {phrase(1, 6)}.'
        if k < 0.12:
            return p + f' <span {pick("class", "id")}="{pick("ad", "ad sponsored", "sponsored-link", "promo", "advert-inline", "inline-ad", "ads")}" data-junk="1">{phrase(1, 6)}</span> ' + (phrase(2, 9) + "." if chance(0.6) else "")
        return p

    def stray() -> str:
        """Text that lies bare among a container's elements and isn't the article's."""
        return pick(phrase(1, 4), f"{phrase(1, 3)} | {phrase(1, 3)}", f"&copy; 20{int(r.integers(10, 26))} {phrase(1, 4)}", prose(1, 2), anchor(), f"{phrase(1, 3)}: {anchor()}")

    def menu() -> str:
        inner = pick(links, row)(int(r.integers(2, 9)))
        return pick(lambda: f"<nav>{inner}</nav>", lambda: box(["menu", "main-nav", "navbar", "nav-links", "topbar", "breadcrumb", "site-navigation"], inner), lambda: box(["nav", "menu"], inner, "nav"), lambda: inner)()

    def head() -> str:
        inner = pick(f"<h1>{phrase(1, 4)}</h1>", f"<div>{phrase(1, 4)}</div>", f"<p>{phrase(2, 9)}</p>", anchor()) + (menu() if chance(0.5) else "")
        return pick(lambda: f"<header>{inner}</header>", lambda: box(["header", "site-header", "masthead", "page-header", "logo"], inner), lambda: f'<header role="banner">{inner}</header>')()

    def foot() -> str:
        inner = pick(f"&copy; {phrase(1, 4)} &middot; {prose(1, 3)}", f"<p>&copy; 20{int(r.integers(10, 26))} {phrase(1, 5)}. {phrase(2, 5)}.</p>", row(4), f"<p>{prose(1, 2)}</p>{links(3)}")
        return pick(lambda: f"<footer>{inner}</footer>", lambda: box(["footer", "site-footer", "colophon", "copyright", "bottom"], inner), lambda: f"<footer>{inner}</footer>")()

    def side() -> str:
        inner = f"<h3>{phrase(1, 4)}</h3>" * chance(0.7) + pick(links(int(r.integers(2, 7))), f"<p>{prose(1, 3)}</p>", f"<p>{phrase(2, 8)}</p>{links(3)}", "".join(f"<div>{anchor(3, 9)}</div>" for _ in range(3)))
        return pick(lambda: f"<aside>{inner}</aside>", lambda: box(["sidebar", "side-bar", "widget", "related-posts", "related", "popular", "rail", "recommended", "right-column sidebar"], inner), lambda: box(["related", "sidebar"], inner, pick("section", "aside", "ul")))()

    def advert() -> str:
        inner = pick(prose(1, 4), f"<p>{prose(1, 2)}</p>", f"{anchor(2, 7)} {phrase(2, 6)}", f"<a href='/x'>{prose(1, 2)}</a>")
        return box(["ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "promo", "ad-container", "banner-ad", "sponsor-box", "adbox ad"], inner, pick("div", "div", "div", "section", "aside", "div" if "<p" in inner else "p"))

    def notice() -> str:
        inner = pick(prose(1, 4), f"<p>{prose(1, 3)}</p><button>{phrase(1, 2)}</button>", f"{prose(1, 2)} {anchor()}", f"<h4>{phrase(1, 4)}</h4><p>{prose(1, 2)}</p>")
        return box(["cookie-notice", "cookie-banner", "gdpr", "notice", "alert", "popup", "newsletter", "consent", "subscribe-box", "site-notice", "modal"], inner, pick("div", "div", "section", "aside"))

    def form() -> str:
        inner = pick(f"<label>{phrase(1, 3)}</label><input name='a'><button>{phrase(1, 2)}</button>", f"<p>{prose(1, 2)}</p><input type='text'><input type='submit'>", f"<h3>{phrase(1, 4)}</h3><label>{phrase(1, 3)} <input></label><textarea>{word()}</textarea>", f"<fieldset><legend>{phrase(1, 3)}</legend>{phrase(1, 6)}<select><option>{word()}</option></select></fieldset>")
        return pick(lambda: f"<form action='/{word()}'>{inner}</form>", lambda: box(["login-form", "search-form", "contact-form"], inner, "form"), lambda: box(["search", "login", "signup"], f"<form>{inner}</form>"))()

    def talk() -> str:
        one = lambda: pick(f"<p>{prose(1, 5)}</p>", f"<div>{phrase(1, 3)}</div><p>{prose(1, 4)}</p>", f"<b>{phrase(1, 3)}</b> {prose(1, 4)}", f"<p>{prose(1, 3)}</p><p>{prose(1, 3)}</p>")
        each = pick("<li>{}</li>", '<div class="comment">{}</div>', '<article class="comment">{}</article>', "<div>{}</div>", '<div class="comment-body">{}</div>')
        inner = f"<h{pick(2, 3)}>{phrase(1, 4)}</h3>" * chance(0.6) + "".join(each.format(one()) for _ in range(int(r.integers(1, 6))))
        return box(["comments", "comment-list", "discussion", "comments-area", "reader-comments", "responses", "user-comments", "replies", "disqus_thread"], inner, pick("div", "section", "section", "ol", "aside"))

    def share() -> str:
        return box(["share", "social-links", "share-buttons", "follow-us"], pick(row(4), links(4), f"{phrase(1, 4)} {row(3)}"))

    def body() -> str:
        out = [f"<h1{main}>{phrase(2, 12)}</h1>"] if chance(0.9) else []
        for _ in range(int(r.integers(0, 2)) if chance(0.2) and out else int(r.integers(1, 10))):
            k = r.random()
            if k < 0.62:
                p = prose(1, 7)
                if chance(0.2):
                    p = f"<b>{phrase(2, 8)}.<br>" + p
                if chance(0.2):
                    p += f" {anchor()} {phrase(2, 9)}."
                out.append(f"<p{main}>{within(p)}" + "</p>" * chance(0.85))
            elif k < 0.68:
                out.append(f"<p{main}>{phrase(1, 4)}.</p>")
            elif k < 0.73:
                out.append(f"<h{pick(2, 3)}{main}>{phrase(1, 8)}</h2>")
            elif k < 0.79:
                out.append(f"<{pick('ul', 'ol')}>" + "".join(f"<li{main}>{pick(phrase(2, 12), prose(1, 3), anchor() + ' ' + phrase(2, 8))}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>")
            elif k < 0.83:
                out.append(f"<blockquote{main}>{prose(1, 3)}</blockquote>")
            elif k < 0.87:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td{main}>{phrase(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif k < 0.90:
                out.append(f"<pre{main}>{word()} = {word()}\n{word()}</pre>")
            elif k < 0.92:
                out.append(f"<figure><img src='x'><figcaption{main}>{phrase(2, 9)}</figcaption></figure>")
            elif k < 0.96:
                out.append(f"<p{main}>" + " | ".join(phrase(1, 3) for _ in range(int(r.integers(5, 40)))) + "</p>")
            else:
                out.append(f"<div{main}>{prose(1, 5)}</div>")
            if chance(0.05):
                out.append(pick(advert, share, notice, side, form)())
        return "".join(out)

    article = body()
    k = r.random()
    if chance(0.06):  # paragraphs of bare text, parted by line breaks or boxes
        own = prose(2, 6) + pick("<br><br>", "<br>", "<hr>").join(prose(1, 5) for _ in range(int(r.integers(1, 5))))
        tag = pick("article", "main", "div", "div", "section")
        article = f'<{tag}{pick("", " class=post-content", " class=entry")}{main}>{own}{pick("", advert(), share(), f"<h2{main}>{phrase(1, 6)}</h2>")}{prose(1, 3) if chance(0.5) else ""}</{tag}>'
    elif k < 0.45:
        article = f"<article>{article}</article>"
    elif k < 0.55:
        article = f"<main>{article}</main>"
    elif k < 0.65:
        article = f'<main><article class="{pick("post", "story", "hentry")}">{article}</article></main>'
    elif k < 0.9:
        article = box(["content", "post-content", "entry-content", "article-body", "main", "story", "main-content", "text", "post"], article, pick("div", "div", "section"))
    elif k < 0.95:
        article = f"<div>{article}</div>"
    if chance(0.25):
        article = article + talk() if chance(0.7) else re.sub(r"(</(?:article|main|div)>)$", lambda m: talk() + m[1], article)
    some = lambda p, *fs: "".join(f() for f in fs if chance(p))
    top = some(0.45, head, menu, notice, advert, form) if chance(0.8) else ""
    low = some(0.4, side, talk, share, notice, form, advert) + (foot() if chance(0.75) else "")
    middle = (side() if chance(0.15) else "") + (advert() if chance(0.2) else "") + article
    bare = lambda p: stray() if chance(p) else ""
    if chance(0.4):
        middle = f'<div class="{pick("wrapper", "container", "page", "row", "site", "content-wrapper", "layout")}">{bare(0.2)}{middle}{side() if chance(0.4) else ""}{bare(0.15)}</div>'
    page = f"<!DOCTYPE html><html><head><title>{phrase(1, 6)}</title><style>p{{}}</style></head><body>{bare(0.12)}{top}{bare(0.05)}{middle}{bare(0.1)}{low}{bare(0.08)}"
    return page + "</body></html>" * chance(0.9)


@dataclass
class Model:
    trees: boosting.Boosted

    def extract(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        parts = [node_features(t) for t in trees]
        z = self.trees.raw(np.concatenate([np.zeros((0, N_FEATURES)), *(x for _, x in parts)]))
        out, at = [], 0
        for t, (rows, _) in zip(trees, parts, strict=True):
            out.append(text_of(t, decode(t, rows, z[at : at + len(rows)])))
            at += len(rows)
        return out


def labelled_nodes(page: str) -> tuple[np.ndarray, np.ndarray, Tree, np.ndarray]:
    """(features, whether main text lies in the node's subtree, tree, nodes that hold text) of a made page."""
    t = parse(page)
    rows, x = node_features(t)
    main = np.array(["data-main" in a and "data-junk" not in a for a in t.marks], bool)
    for e in range(len(t.tag) - 1, 0, -1):
        main[t.parent[e]] |= main[e]
    return x, main[rows], t, rows


_fitted: list[Model] = []


def fit(pages: int = 700, seed: int = 3) -> Model:
    """Fit to made pages; the same model each time."""
    if not _fitted:
        r = np.random.default_rng(seed)
        xs, ys = zip(*(labelled_nodes(_page(r))[:2] for _ in range(pages)), strict=True)
        _fitted.append(Model(boosting.fit(np.concatenate(xs), np.concatenate(ys), trees=40, depth=4, rate=0.3, bins=24)))
    return _fitted[0]


def extract(pages: DataFrame, model: Model, key: str = "page_id", keep: tuple[str, ...] = ("url",), html: str = "html") -> DataFrame:
    """(key, kept columns, text, n_chars) of every row."""
    import pyarrow as pa

    ship(pages.sparkSession)
    n = 1 + len(keep)
    chosen = pages.select(key, *keep, F.col(html).cast("string").alias("_html"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = model.extract([x or "" for x in part.column(n).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, *keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return chosen.mapInArrow(run, f"{schema}, text string, n_chars bigint")
