"""Text functions that are folds or scanners, for mapInArrow or plain use: JSON splitting, chunk folds, table chunks, page reduction, stems."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from .dom import parse


def json_objects(text: str) -> tuple[list, list[str]]:
    """(parsed, rest) of the brace-balanced objects in a text; strings may hold braces."""
    good, bad, depth, start, quoted, escaped = [], [], 0, 0, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                piece = text[start : i + 1]
                try:
                    good.append(json.loads(piece))
                except ValueError:
                    bad.append(piece)
    if depth:
        bad.append(text[start:])
    return good, bad


def merge_by_tokens(chunks: Iterable[str], most: float, rate: float = 1.3) -> list[str]:
    """Join chunks by blank lines as long as they stay within an estimated number of tokens."""
    out: list[list[str]] = []
    held = 0.0
    for c in chunks:
        n = len(c.split()) * rate
        if out and held + n <= most:
            out[-1].append(c)
            held += n
        else:
            out.append([c])
            held = n
    return ["\n\n".join(x) for x in out]


def stream_chunks(docs: Iterable[str], size: int, rate: float = 1.0) -> Iterator[str]:
    """Chunks of about size weighted words over a stream of texts; a text's words may begin in one chunk and end in the next."""
    held: list[str] = []
    for d in docs:
        held += d.split()
        step = max(1, int(size / rate))
        while len(held) >= step:
            yield " ".join(held[:step])
            held = held[step:]
    if held:
        yield " ".join(held)


def table_chunks(html: str, rows: int) -> list[str]:
    """A table cut into tables of so many body rows, each with the head repeated."""
    t = parse(html).find("table")
    if t is None:
        return []
    head = t.find("thead")
    body = [r for r in t.all("tr") if head is None or r not in head.all("tr")]
    if head is None and body and any(getattr(c, "tag", "") == "th" for c in body[0].children):
        top, body = body[0].html(), body[1:]
    else:
        top = head.html() if head is not None else ""
    return [f"<table>{top}<tbody>{''.join(r.html() for r in body[i : i + rows])}</tbody></table>" for i in range(0, max(1, len(body)), rows)]


def reduced(html: str, most_text: int = 100, most: int | None = None) -> str:
    """A page for the design of extraction rules: few attributes, short texts, of equal subtrees one."""
    root = parse(html)
    for n in list(root.walk()):
        if n.tag in ("head", "script", "style", "noscript", "svg", "iframe", "link", "meta", "template", "canvas", "video", "audio"):
            n.remove()
    seen = set()
    for n in list(root.walk()):
        n.attrs = {k: v[:most_text] for k, v in n.attrs.items() if k in ("id", "class", "name", "type", "value", "href") or k.startswith("data-")}
        n.children = [c if not isinstance(c, str) else c if len(c) <= most_text else c[:most_text] + "..." for c in n.children]
        key = (n.tag, n.attrs.get("class"), n.text())
        if key[2] and key in seen and n.parent is not None and n.parent.tag != "#root":
            n.remove()
        seen.add(key)
    out = root.html()
    return out if most is None else out[:most]


_STEPS = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("ousli", "ous"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]


def _measure(w: str) -> int:
    return len(re.findall(r"[aeiouy]+[^aeiouy]+", w))


def stem(word: str) -> str:
    """A light English stem: plurals, -ed and -ing, common noun endings."""
    w = word.lower()
    if len(w) < 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    for end in ("eed", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end == "eed":
                w = base + "ee" if _measure(base) else w
            elif re.search("[aeiouy]", base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
            break
    if w.endswith("y") and re.search("[aeiou]", w[:-1]):
        w = w[:-1] + "i"
    for end, new in _STEPS:
        if w.endswith(end) and _measure(w[: -len(end)]):
            return w[: -len(end)] + new
    return w


def pdf_paragraphs(text: str) -> str:
    """HTML of a PDF page's text: headings are short lines without a full stop, broken lines are joined, hyphens undone."""
    from html import escape

    out = []
    for block in re.split(r"\n\s*\n", text or ""):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        joined = re.sub(r"(\w)- (?=[a-z])", r"\1", " ".join(lines))
        tag = "h2" if len(lines) == 1 and len(joined) < 60 and not joined.endswith((".", ",", ";", ":")) else "p"
        out.append(f"<{tag}>{escape(joined)}</{tag}>")
    return "\n".join(out)
