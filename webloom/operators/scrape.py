"""Operators on page trees: cleaning, metadata, media, tables, text blocks, pruning, markdown, schema extraction.

Each page is parsed once, in one Python pass, for all features asked for; the rest is explode() and plain columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dom import VOID, Node, parse, select, xpath
from ..functions.urls import SECOND_LEVEL
from ..plans.config import setting

FEATURES = {
    "cleaned_html": "string",
    "metadata": "map<string,string>",
    "media": "array<struct<kind:string,pos:int,src:string,alt:string,score:int,width:int>>",
    "tables": "array<struct<pos:int,headers:array<string>,rows:array<array<string>>,caption:string,score:double>>",
    "blocks": "array<struct<pos:int,tag:string,text:string>>",
    "pruned_html": "string",
    "markdown": "string",
    "fit_markdown": "string",
    "page_query": "string",
    "anchors": "array<struct<pos:int,href:string,text:string,title:string,base:string>>",
}
_KEEP_ATTRS = tuple("alt height href src title width".split())
_KEEP_EMPTY = frozenset("a img br hr input video audio source iframe td th pre code".split()) | VOID
_INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img kbd label mark q s samp small span strong sub sup time tt u var".split())


#: Inline elements that give way to their text where only text is wanted.
_TEXT_ONLY = frozenset("abbr b cite code del dfn em i ins kbd mark q s small span strong sub sup time u var".split())


@setting
@dataclass(frozen=True)
class Selection:
    """What of a page is kept: target: selectors whose matches, one after the other, become the content; excluded: tags that go; selector: matches that go; only_text: inline elements become their text; least_words: leaf elements with fewer words go; domains: base domains whose links and images go; forms: whether forms stay; closed: character references count only with their semicolons (see parse)."""

    target: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    selector: str = ""
    only_text: bool = False
    least_words: int = 1
    domains: tuple[str, ...] = ()
    forms: bool = True
    keep_data: bool = False
    closed: bool = False


def anchors(root: Node) -> list[dict]:
    """Links in page order with all the text within them, their titles, and the base address that the head names."""
    base = next((b.attrs["href"].strip() for b in root.all("base") if b.attrs.get("href", "").strip()), None)
    found = [n for n in root.all("a") if n.attrs.get("href", "").strip()]
    return [{"pos": i, "href": n.attrs["href"].strip(), "text": "".join(n.pieces()).strip(), "title": n.attrs.get("title", "").strip(), "base": base} for i, n in enumerate(found)]


def _domain(url: str) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#:]*)", url)
    labels = m[1].lower().removeprefix("www.").split(".") if m else []
    return ".".join(labels[-3:] if len(labels) > 2 and labels[-2] in SECOND_LEVEL else labels[-2:])


def choose(root: Node, s: Selection) -> Node:
    """A page's tree after a selection, without attributes beyond a few."""
    if s.target:
        picked = [n for one in s.target for n in select(root.find("body") or root, one)]
        root = Node("#root")
        box = Node("div", parent=root)
        root.children.append(box)
        for n in picked:
            box.children.append(copy := parse(n.html(), s.closed).children[0])
            copy.parent = box
    if s.domains:
        for n in root.all("a", "img"):
            if _domain(n.attrs.get("href" if n.tag == "a" else "src", "")) in s.domains:
                n.remove()
    if s.only_text:
        for n in root.walk():
            if n.tag in _TEXT_ONLY and not any(a.tag in _TEXT_ONLY for a in _above(n)):
                n.tag, n.attrs, n.children = "span", {}, [n.whole()]
    return clean(root, s.excluded, s.selector, s.keep_data, s.forms, s.least_words)


def clean(root: Node, excluded: Iterable[str] = (), selector: str = "", keep_data: bool = False, forms: bool = True, least_words: int = 1) -> Node:
    """Without scripts, styles and excluded parts, leaf elements of too few words (not in code) and attributes beyond a few."""
    gone = {*"link meta noscript script style".split(), *excluded} | (set() if forms else {"form"})
    for n in list(root.walk()):
        if n.tag in gone:
            n.remove()
    if selector:
        for n in select(root, selector):
            n.remove()
    for n in reversed(list(root.walk())):
        if n.tag not in _KEEP_EMPTY and not any(isinstance(c, Node) for c in n.children) and len(n.text(" ").split()) < least_words and n.tag not in ("html", "body", "#root") and not any(a.tag in ("pre", "code") for a in _above(n)):
            n.remove()
    for n in root.walk():
        n.attrs = {k: v for k, v in n.attrs.items() if k in _KEEP_ATTRS or keep_data and k.startswith("data-")}
    return root


def metadata(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    if (t := root.find("title")) is not None and t.text():
        out["title"] = " ".join(t.text().split())
    for m in root.all("meta"):
        name = (m.attrs.get("name") or m.attrs.get("property") or "").lower()
        if "content" in m.attrs and (name in ("description", "keywords", "author", "robots") or name.startswith(("og:", "twitter:", "article:"))):
            out.setdefault(name, m.attrs["content"].strip())
        elif m.attrs.get("charset"):
            out.setdefault("charset", m.attrs["charset"].lower())
    if "title" not in out:
        h = root.find("h1")
        if alt := out.get("og:title") or out.get("twitter:title") or (h.text() if h else ""):
            out["title"] = alt
    if (h := root.find("html")) is not None and h.attrs.get("lang"):
        out["lang"] = h.attrs["lang"]
    for k in root.all("link"):
        if k.attrs.get("rel", "").lower() == "canonical" and k.attrs.get("href"):
            out.setdefault("canonical", k.attrs["href"])
    return out


def _sources(value: str) -> list[str]:
    return [p.split()[0] for p in value.split(",") if p.strip()]


def media(root: Node, least: int = 2) -> list[dict]:
    """Images that score above least, videos and sounds. Buttons, icons and logos aren't images."""
    out: list[dict] = []
    images = root.all("img")
    for i, n in enumerate(images):
        around = " ".join(n.parent.classes()).lower() if n.parent else ""
        named = f"{around} {n.attrs.get('src', '')} {n.attrs.get('alt', '')}".lower()
        if "display:none" in n.attrs.get("style", "").replace(" ", "") or n.parent is not None and n.parent.tag in ("button", "input") or any(w in named for w in ("button", "icon", "logo")):
            continue
        width, height = n.attrs.get("width", ""), n.attrs.get("height", "")
        sources = [s for k in ("src", "data-src", "data-lazy-src") if (s := n.attrs.get(k))] + _sources(n.attrs.get("srcset", "") or n.attrs.get("data-srcset", ""))
        framed = n.parent is not None and n.parent.tag == "picture"
        if framed:
            sources += [u for s in n.parent.all("source") for u in _sources(s.attrs.get("srcset", ""))]
        score = (width.isdigit() and int(width) > 150) + (height.isdigit() and int(height) > 150) + bool(n.attrs.get("alt")) + (i / len(images) < 0.5) + any(re.search(r"\.(?:jpe?g|png|webp|avif|gif)\b", s, re.I) for s in sources) + ("srcset" in n.attrs) + framed
        if score > least:
            out += [{"kind": "image", "src": s, "alt": n.attrs.get("alt"), "score": int(score), "width": int(width) if width.isdigit() else None} for s in dict.fromkeys(sources)]
    for kind in ("video", "audio"):
        for n in root.all(kind):
            out += [{"kind": kind, "src": s, "alt": n.attrs.get("title"), "score": 0, "width": None} for s in [n.attrs.get("src"), *(x.attrs.get("src") for x in n.all("source"))] if s]
    return [x | {"pos": i} for i, x in enumerate(out)]


def _rows(t: Node) -> list[Node]:
    return [r for r in t.all("tr") if next(a for a in _above(r) if a.tag == "table") is t]


def _above(n: Node):
    n = n.parent
    while n is not None:
        yield n
        n = n.parent


def table_score(t: Node) -> float:
    """Signs that a table holds data rather than a layout."""
    rows = _rows(t)
    if not rows:
        return -99.0
    head = t.find("thead") is not None
    score = 2.0 * head + 1.0 * (t.find("tbody") is not None)
    if t.find("th") is not None:
        first = any(isinstance(c, Node) and c.tag == "th" for c in rows[0].children)
        score += 2 + (head or first)
    score -= 3 * (t.find("table") is not None) + 3 * (t.attrs.get("role", "").lower() in ("presentation", "none"))
    columns = [sum(isinstance(c, Node) and c.tag in ("td", "th") for c in r.children) for r in rows]
    mean = sum(columns) / len(columns)
    score += 2 * (sum((c - mean) ** 2 for c in columns) / len(columns) < 1)
    score += 2 * (t.find("caption") is not None) + bool(t.attrs.get("summary"))
    ratio = len(t.text()) / (sum(1 for _ in t.walk()) + 1)
    score += 3 if ratio > 20 else 2 if ratio > 10 else 0
    return score + 0.5 * sum(k.startswith("data-") for k in t.attrs) + 2 * (len(rows) >= 2 and mean >= 2)


def table_data(t: Node) -> dict:
    """Headers and rows: spanned cells repeat, short rows are filled, long ones cut at the headers."""

    def cells(r: Node, *tags: str) -> list[str]:
        out: list[str] = []
        for c in r.children:
            if isinstance(c, Node) and c.tag in tags:
                span = c.attrs.get("colspan", "1")
                out += [" ".join(c.text(" ").split())] * (int(span) if span.isdigit() and 0 < int(span) <= 1000 else 1)
        return out

    rows = _rows(t)
    head = t.find("thead")
    headers, body = [], rows
    if head is not None and head.find("tr") is not None:
        first = head.find("tr")
        headers = cells(first, "th", "td")
        body = [r for r in rows if not any(a.tag == "thead" for a in _above(r))]
    elif rows:
        headers = cells(rows[0], "th", "td")
        if any(isinstance(c, Node) and c.tag == "th" for c in rows[0].children):
            body = rows[1:]
    data = [x for r in body if (x := cells(r, "td"))]
    if not headers and data:
        width = max(len(x) for x in data)
        headers = ["Column " + str(k) for k in range(1, width + 1)]
    n = len(headers)
    caption = t.find("caption")
    return {"headers": headers, "rows": [(x + [""] * n)[:n] for x in data], "caption": caption.text(" ") if caption else ""}


def tables(root: Node, least: float = 7.0) -> list[dict]:
    found = [(t, s) for t in root.all("table") if (s := table_score(t)) >= least]
    return [table_data(t) | {"pos": i, "score": float(s)} for i, (t, s) in enumerate(found)]


def blocks(root: Node) -> list[dict]:
    """Runs of text in block elements, in order, with the tag around them."""
    out: list[dict] = []
    start = root.find("body") or root
    held: list[str] = []
    owner = start.tag

    def flush(tag: str) -> None:
        s = " ".join("".join(held).split())
        held.clear()
        if s:
            out.append({"pos": len(out), "tag": tag, "text": s})

    stack: list = [(c, start.tag) for c in reversed(start.children)]
    while stack:
        c, tag = stack.pop()
        if c is None:
            flush(tag)
        elif isinstance(c, str):
            held.append(c)
        elif c.tag in ("script", "style", "noscript", "head", "template"):
            continue
        elif c.tag in _INLINE:
            stack += [(x, tag) for x in reversed(c.children)]
        else:
            flush(tag)
            stack.append((None, c.tag))
            stack += [(x, c.tag) for x in reversed(c.children)]
    flush(owner)
    return out


_TAG_WEIGHT = {f"h{k}": round(1.3 - k / 10, 1) for k in range(1, 7)} | dict(span=0.3, div=0.5, section=1.0, p=1.0, article=1.5)


_FRAME = frozenset("aside footer form head header iframe nav noscript script style".split())


def prune_score(n: Node, min_words: int | None = None) -> float:
    text = n.text()
    if min_words is not None and text.count(" ") + 1 < min_words:
        return -1.0
    size = len(n.inner_html())
    linked = sum(len(c.text()) for c in n.children if isinstance(c, Node) and c.tag == "a")
    density = len(text) / size if size else 0.0
    links = 1 - (linked / len(text) if text else 0.0)
    return 0.4 * density + 0.2 * links + 0.2 * _TAG_WEIGHT.get(n.tag, 0.5) + 0.1 * math.log(len(text) + 1)


def prune(root: Node, threshold: float = 0.48, dynamic: bool = False, min_words: int | None = None) -> Node:
    """Without menus, frames, forms and elements of low density; what stands in a removed element isn't looked at."""
    for n in list(root.walk()):
        if n.tag in _FRAME:
            n.remove()
    stack = [c for c in (root.find("body") or root).children if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        limit = threshold
        if dynamic:
            text = n.text()
            size = len(n.inner_html())
            linked = sum(len(c.text()) for c in n.children if isinstance(c, Node) and c.tag == "a")
            limit *= (0.8 if _TAG_WEIGHT.get(n.tag, 0.5) > 1 else 1) * (0.9 if size and len(text) / size > 0.4 else 1) * (1.2 if not text or linked / len(text) > 0.6 else 1)
        if prune_score(n, min_words) < limit:
            n.remove()
        else:
            stack += [c for c in n.children if isinstance(c, Node)]
    return root


def markdown(root: Node) -> str:
    """Headings, paragraphs, lists, emphasis, links, images, quotes, code and tables as markdown."""
    out: list[str] = []

    def inline(n: Node) -> str:
        s = "".join(c if isinstance(c, str) else span(c) for c in n.children)
        return re.sub(r"[ \t\r\f]*\n[ \t\r\f\n]*|[ \t\r\f]+", lambda m: "\n" if "\0" in m[0] else " ", s)

    def span(c: Node) -> str:
        if c.tag in ("script", "style", "noscript", "template", "head"):
            return ""
        if c.tag == "br":
            return "  \n"
        if c.tag == "img":
            return f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})"
        s = inline(c)
        core = s.strip()
        if not core:
            return s
        mark = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "tt": "`", "del": "~~", "s": "~~"}.get(c.tag)
        if mark:
            core = mark + core + mark
        elif c.tag == "a" and c.attrs.get("href"):
            title = f' "{c.attrs["title"]}"' if c.attrs.get("title") else ""
            core = f"[{core}]({c.attrs['href']}{title})"
        return s[: len(s) - len(s.lstrip())] + core + s[len(s.rstrip()) :]

    def put(text: str, prefix: str) -> None:
        t = "\n".join(x.rstrip() if not x.endswith("  ") else x for x in text.strip().split("\n"))
        if t:
            out.append("\n".join(prefix + x for x in t.split("\n")))

    def block(n: Node, prefix: str, depth: int) -> None:
        run: list[Node | str] = []

        def flush() -> None:
            shell = Node("#root")
            shell.children = list(run)
            put(inline(shell), prefix)
            run.clear()

        for c in n.children:
            if isinstance(c, str) or c.tag in _INLINE or depth > 200:
                run.append(c)
                continue
            flush()
            if c.tag in ("script", "style", "noscript", "template", "head"):
                continue
            if re.fullmatch("h[1-6]", c.tag):
                put("#" * int(c.tag[1]) + " " + inline(c).strip().replace("\n", " "), prefix)
            elif c.tag in ("ul", "ol"):
                lines = []
                for k, li in enumerate(x for x in c.children if isinstance(x, Node) and x.tag == "li"):
                    at = len(out)
                    block(li, "", depth + 1)
                    own = "\n".join(out[at:])
                    del out[at:]
                    mark = f"{k + 1}. " if c.tag == "ol" else "* "
                    lines.append(mark + own.replace("\n", "\n" + " " * len(mark)))
                put("\n".join(lines), prefix)
            elif c.tag == "blockquote":
                block(c, prefix + "> ", depth + 1)
            elif c.tag == "pre":
                out.append("\n".join(prefix + x for x in ["```", *"".join(c.pieces()).strip("\n").split("\n"), "```"]))
            elif c.tag == "hr":
                put("* * *", prefix)
            elif c.tag == "table":
                d = table_data(c)
                if d["headers"]:
                    line = lambda xs: "| " + " | ".join(x.replace("|", r"\|") for x in xs) + " |"
                    put("\n".join([line(d["headers"]), line(["---"] * len(d["headers"])), *map(line, d["rows"])]), prefix)
            else:
                block(c, prefix, depth + 1)
        flush()

    block(root.find("body") or root, "", 0)
    return "\n\n".join(out)


def page_query(root: Node) -> str:
    """What a page says that it is about: title, first heading, keywords and description; else its first long paragraph."""
    m = metadata(root)
    h = root.find("h1")
    parts = [m.get("title", ""), h.text(" ") if h else "", m.get("keywords", ""), m.get("description", "")]
    said = " ".join(p for p in parts if p)
    return said or next((t[:150] for p in root.all("p") if len(t := p.text(" ")) > 150), "")


def features_of(html: str | None, wanted: Iterable[str], selection: Selection = Selection()) -> dict:
    """wanted features of a page; a selection bears on cleaned_html and, with a target, on markdown and blocks; its `closed` on all."""
    wanted = set(wanted)
    root = parse(html, selection.closed)
    out: dict = {}
    for name, f in (("metadata", metadata), ("page_query", page_query), ("media", media), ("tables", tables), ("anchors", anchors)):
        if name in wanted:
            out[name] = f(root)
    content = choose(parse(html, selection.closed), selection) if selection.target else root
    for name, f in (("blocks", blocks), ("markdown", markdown)):
        if name in wanted:
            out[name] = f(content)
    if "pruned_html" in wanted or "fit_markdown" in wanted:
        p = prune(parse(html, selection.closed))
        if "pruned_html" in wanted:
            out["pruned_html"] = p.html()
        if "fit_markdown" in wanted:
            out["fit_markdown"] = markdown(p)
    if "cleaned_html" in wanted:
        out["cleaned_html"] = choose(root, selection).html()
    return out


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores (small files of one row group) dealt to all of them; any other as it is, without a shuffle."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of html that a Python worker holds as trees and results at once, a single longer page aside.
PART = 1 << 20


def _parts(batch, most: int | None = None):
    """An Arrow batch in slices of so many bytes in its second column, so that a worker's memory doesn't follow the size of batches."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = (np.cumsum(size) - size) // (most or PART)
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(size)]
    return (batch.slice(a, z - a) for a, z in zip(cuts, cuts[1:]) if z > a)


def scrape(pages: DataFrame, wanted: Iterable[str], key: str = "page_id", html: str = "html", selection: Selection = Selection()) -> DataFrame:
    """(key, a column for each wanted feature) of every page."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = list(wanted)
    kind = pages.schema[key].dataType.simpleString()
    ddl = ", ".join([f"`{key}` {kind}", *(f"{w} {FEATURES[w]}" for w in wanted)])
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches):
        for b in (p for whole in batches for p in _parts(whole)):
            rows = [features_of(h, wanted, selection) for h in b.column(1).to_pylist()]
            cols = [b.column(0), *(pa.array([list(r[w].items()) if w == "metadata" else r[w] for r in rows], schema.field(w).type) for w in wanted)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return spread(pages.select(key, html)).mapInArrow(run, ddl)


# Extraction by a schema: {baseSelector, fields: [{name, type, selector, attribute, pattern, transform, default, fields}]}.


def schema_type(schema: dict) -> T.StructType:
    """The item type of an extraction schema."""

    def of(f: dict) -> T.DataType:
        if f["type"] == "nested":
            return T.StructType([T.StructField(x["name"], of(x)) for x in f["fields"]])
        if f["type"] in ("list", "nested_list"):
            return T.ArrayType(T.StructType([T.StructField(x["name"], of(x)) for x in f["fields"]]))
        return T.StringType()

    return T.StructType([T.StructField(f["name"], of(f)) for f in [*schema.get("baseFields", []), *schema["fields"]] if f["type"] != "computed"])


def _value(n: Node, f: dict, find):
    kind = f["type"]
    if kind in ("list", "nested_list"):
        return [{x["name"]: _value(m, x, find) for x in f["fields"]} for m in find(n, f["selector"])]
    at = (find(n, f["selector"]) or [None])[0] if f.get("selector") else n
    if kind == "nested":
        return None if at is None else {x["name"]: _value(at, x, find) for x in f["fields"]}
    out = None
    if at is not None:
        if kind == "text":
            out = at.text(f.get("separator", ""))
        elif kind == "attribute":
            out = at.attrs.get(f["attribute"])
        elif kind == "html":
            out = at.html()
        elif kind == "regex":
            m = re.search(f["pattern"], at.text(" "))
            out = m[1] if m and m.groups() else m[0] if m else None
        else:
            raise ValueError(f"field type {kind!r}")
    if out is None:
        return f.get("default")
    return {"lowercase": str.lower, "uppercase": str.upper, "strip": str.strip}.get(f.get("transform", ""), str)(out)


def lenient(find):
    """A finder that, where a selector finds nothing within an element, tries it less strictly: its last compound, then that without its tag's place, then the last class or tag alone."""

    def found(n: Node, selector: str) -> list[Node]:
        tries = [selector, (last := re.split(r"[\s>+~]+", selector.strip())[-1]), re.sub(r":[\w-]+(?:\([^)]*\))?", "", last)]
        tries += [m[0] for m in [re.findall(r"\.[\w-]+", last)[-1:], re.findall(r"^[a-zA-Z][\w-]*", last)] if m]
        return next((hit for s in dict.fromkeys(tries) if s and (hit := find(n, s))), [])

    return found


def extract(pages: DataFrame, schema: dict, by: str = "css", key: str = "page_id", html: str = "html", closed: bool = False) -> DataFrame:
    """(key, pos, a column for each field) of every item; by is css, xpath, or lenient: css whose field selectors fall back to less strict ones; closed as in parse(). Computed fields are SQL expressions over the others."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    find = xpath if by == "xpath" else select
    within = lenient(select) if by == "lenient" else find
    kind = pages.schema[key].dataType
    item = schema_type(schema)
    out = T.StructType([T.StructField(key, kind), T.StructField("pos", T.IntegerType()), *item.fields])
    arrow = to_arrow_schema(out)
    base = schema.get("baseFields", [])
    plain = [f for f in schema["fields"] if f["type"] != "computed"]

    def run(batches):
        for b in (p for whole in batches for p in _parts(whole)):
            rows = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, n in enumerate(find(parse(h, closed), schema["baseSelector"])):
                    rows.append({key: k, "pos": i} | {f["name"]: _value(n, f, within) for f in base + plain})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    found = spread(pages.select(key, html)).mapInArrow(run, out)
    for f in schema["fields"]:
        if f["type"] == "computed":
            found = found.withColumn(f["name"], F.expr(f["expression"]))
    return found
