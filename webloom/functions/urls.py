"""URL expressions: parts, resolution, normalisation, predicates and scores."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = tuple("fbclid gclid ref ref_src utm_campaign utm_content utm_medium utm_source utm_term".split())
TRACKING_DEEP = tuple("fbclid ref utm_campaign utm_medium utm_source".split())
SECOND_LEVEL = tuple("ac ad ae af ag co com edu gov int mil net org".split())
SPECIAL_SCHEMES = tuple(f"{s}:" for s in "data file ftp javascript mailto tel".split())
#: Media types with their extensions.
_TYPES = """
application/atom+xml atom
application/gzip gz
application/javascript js
application/json json
application/msword doc
application/pdf pdf
application/rss+xml rss
application/xml xml
application/zip zip
audio/mpeg mp3
audio/ogg ogg
audio/wav wav
font/ttf ttf
font/woff woff
font/woff2 woff2
image/gif gif
image/jpeg jpeg jpg
image/png png
image/svg+xml svg
image/webp webp
image/x-icon ico
text/css css
text/csv csv
text/html htm html php
text/plain txt
video/mp4 mp4
video/webm webm
video/x-msvideo avi
"""
MIME = {ext: kind for kind, *exts in map(str.split, _TYPES.strip().split("\n")) for ext in exts}


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scheme(u: Column) -> Column:
    return F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)


def netloc(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def host(u: Column) -> Column:
    """Without port."""
    return F.regexp_extract(netloc(u), r"^([^:]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL of href as it stands on a page at base; null for an empty href."""
    h = F.trim(href)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path(base) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(no_query, r"[^/]*$", ""))
    joined = F.concat(folder, h)
    head, tail = F.regexp_extract(joined, r"^([^?#]*)", 1), F.regexp_extract(joined, r"^[^?#]*([?#].*)?$", 1)
    for _ in range(6):
        head = F.regexp_replace(F.regexp_replace(head, r"/\./", "/"), r"(?<![:/])/(?!\.\./)[^/]+/\.\./", "/")
    head = F.regexp_replace(head, r"(?<=[^:/])(?:/\.\.)+/", "/")
    return (
        F.when(F.coalesce(h, F.lit("")) == "", F.lit(None))
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(no_query, h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), h))
        .otherwise(F.concat(head, tail))
    )


def normalise(u: Column, dropped: Iterable[str] = TRACKING, sort: bool = True) -> Column:
    """Lower-case host, no trailing slash but the root's, no fragment, no tracking parameters; keys lower-cased and, if sort, in order (equal keys as they came). Percent-encoding is left as it is."""
    p = path(u)
    p = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/+$", "")).otherwise(p)
    raw = F.filter(F.split(query(u), "&"), lambda x: x != "")
    pairs = F.transform(raw, lambda x, i: F.struct(F.lower(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"), i.alias("i"), F.regexp_extract(x, r"^[^=]*=?(.*)$", 1).alias("v")))
    kept = F.filter(pairs, lambda x: ~x["k"].isin(*dropped))
    kept = F.array_sort(kept) if sort else kept
    q = F.array_join(F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    return F.concat(F.lower(scheme(u)), F.lit("://"), netloc(u), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def normalise_deep(u: Column) -> Column:
    """The form for traversal: blank values and five tracking parameters go, order stays, the root's slash too goes."""
    raw = F.filter(F.split(query(u), "&"), lambda x: x.rlike("^[^=]+=.") & ~F.regexp_extract(x, r"^([^=]*)", 1).isin(*TRACKING_DEEP))
    q = F.array_join(raw, "&")
    return F.concat(F.lower(scheme(u)), F.lit("://"), netloc(u), F.regexp_replace(path(u), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def normalise_light(href: Column, base: Column) -> Column:
    """Resolved, with the host in lower case, without fragment and slashes at the path's end; the query stays as it is."""
    u = resolve(base, href)
    q = F.regexp_extract(u, r"^[^?#]*(\?[^#]+)", 1)
    return F.concat(F.lower(scheme(u)), F.lit("://"), netloc(u), F.regexp_replace(path(u), "/+$", ""), q)


def normalise_by_parts(href: Column, base: Column) -> Column:
    """Put together from the base's protocol and host only: special schemes and absolute urls as they are, fragments at the base's end, all else from the root."""
    parts = F.split(base, "/")
    origin = F.concat(F.get(parts, 0), F.lit("//"), F.get(parts, 2))
    special = any_of(F.lower(href).startswith(s) for s in SPECIAL_SCHEMES)
    return (
        F.when(special, F.trim(href))
        .when(href.startswith("#"), F.concat(base, href))
        .when(href.startswith("//"), F.concat(F.get(parts, 0), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(~href.rlike("^https?://"), F.concat(origin, F.lit("/"), F.regexp_replace(href, "^[./]+", "")))
        .otherwise(F.trim(href))
    )


def is_docs_site(u: Column) -> Column:
    return any_of(F.contains(netloc(u), F.lit(x)) for x in ("docs.", "api.", "developer.", "reference."))


SOCIAL = tuple(f"{x}.com" for x in "facebook instagram linkedin pinterest reddit snapchat tiktok twitter x".split())


def excluded_domains(*lists: Iterable[str], social: bool = False) -> Column:
    """The union of lists of domains, and of the social networks if asked for, as one sorted array."""
    every = sorted({d for ds in lists for d in ds} | (set(SOCIAL) if social else set()))
    return F.array(*map(F.lit, every)) if every else F.array().cast("array<string>")


def base_domain(u: Column) -> Column:
    """The last two labels of the host, or three where the second last is a registry's."""
    h = F.regexp_replace(host(u), r"^www\.", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    three = (n > 2) & F.element_at(labels, F.greatest(n - 1, F.lit(1))).isin(*SECOND_LEVEL)
    return F.array_join(F.when(three, F.slice(labels, -3, 3)).when(n > 1, F.slice(labels, -2, 2)).otherwise(labels), ".")


def is_external(u: Column, base: Column, dotted: bool = False) -> Column:
    """Special schemes are external, urls without a host internal; else the host must end with the base domain (at a dot if dotted)."""
    strip = lambda c: F.replace(F.lower(c), F.lit("www."), F.lit(""))
    own, b = strip(netloc(u)), strip(base)
    inside = (own == b) | F.endswith(own, F.concat(F.lit("."), b)) if dotted else F.endswith(own, b)
    return any_of(F.lower(u).startswith(s) for s in SPECIAL_SCHEMES) | ((netloc(u) != "") & ~inside)


def extension(u: Column) -> Column:
    return F.lower(F.regexp_extract(path(u), r"\.([A-Za-z0-9]+)$", 1))


def depth(u: Column) -> Column:
    return F.size(F.filter(F.split(path(u), "/"), lambda x: x != ""))


def year(u: Column, current: int = 2024) -> Column:
    """The latest year up to current that follows a slash, dash or underscore; null if none does."""
    years = F.transform(F.regexp_extract_all(u, F.lit(r"[/_-]((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y <= current))


def glob(u: Column, pattern: str) -> Column:
    """Shell-style: * any characters, ? one, [..] a set."""
    out = "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]" else re.escape(c) for c in pattern)
    return u.rlike(f"(?s)^{out}$")


def seed_glob(u: Column, pattern: str) -> Column:
    """The url, the url without scheme, or that without `www.`."""
    bare = F.regexp_replace(u, r"^https?://", "")
    return glob(u, pattern) | glob(bare, pattern) | glob(F.regexp_replace(bare, r"^www\.", ""), pattern)


def content_type_allowed(u: Column, allowed: Iterable[str]) -> Column:
    """By the extension's media type; a url without extension passes."""
    ext = extension(u)
    mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    known = F.coalesce(F.try_element_at(mime, ext), F.lit(""))
    return (ext == "") | any_of(F.contains(known, F.lit(a)) for a in allowed)


def domain_allowed(u: Column, allowed: Iterable[str] = (), blocked: Iterable[str] = ()) -> Column:
    """Domains with their subdomains; a blocked domain wins; without an allowed list all others pass."""
    own = netloc(u)
    within = lambda ds: any_of((own == d) | own.endswith("." + d) for d in ds)
    ok = ~within(blocked)
    return ok & within(allowed) if allowed else ok


_UTILITY = "ads.txt humans.txt security.txt crossdomain.xml browserconfig.xml manifest.json apple-app-site-association favicon.ico apple-touch-icon.png android-chrome-192x192.png robots.txt sitemap.xml sitemap_index.xml".split()
_NO_CONTENT = "/wp-admin /wp-includes /wp-content/uploads /admin /login /signin /signup /register /checkout /cart /account /profile /search /404 /error /.git /.svn /.hg /cgi-bin /scripts /includes".split()


def is_nonsense(u: Column) -> Column:
    """Robots and sitemap files, utility files, hidden parts, pages without content, printed pages, very short paths."""
    p = F.lower(path(u))
    names = "|".join(re.escape(x) for x in _UTILITY)
    parts = "|".join(re.escape(x) for x in _NO_CONTENT)
    short = (F.length(F.regexp_replace(p, "^/+|/+$", "")) < 3) & ~p.isin("/", *(f"/{x}" for x in "de en es fr it".split()))
    return p.rlike(rf"/(?:{names})$") | p.rlike(r"/sitemap.*(?:\.xml|\.xml\.gz|\.txt)$") | p.rlike(r"/\.") | p.rlike(parts) | F.lower(u).rlike(r"[?&]print=|/print/|_print\.") | short


def can_process(u: Column) -> Column:
    return u.rlike(r"^https?://[^/?#]*\.[^/?#]*")


# Scores.


def keyword_score(u: Column, keywords: list[str]) -> Column:
    return sum((F.contains(F.lower(u), F.lit(k.lower())).cast("double") for k in keywords), F.lit(0.0)) / len(keywords)


def depth_score(u: Column, best: int = 3) -> Column:
    return F.lit(1.0) / (F.lit(1) + F.abs(depth(u) - best))


def content_type_score(u: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for ext, w in weights.items():
        out = F.when(extension(u) == ext, w).otherwise(out)
    return out


def freshness_score(u: Column, current: int = 2024) -> Column:
    d = F.lit(current) - year(u, current)
    return F.when(d.isNull(), 0.5).when(d < 6, F.lit(1.0) - d * 0.1).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - d * 0.1))


def authority_score(u: Column, weights: dict[str, float], default: float = 0.5) -> Column:
    out = F.lit(default)
    for d, w in weights.items():
        out = F.when(host(u) == d, w).otherwise(out)
    return out


def composite(scores: list[tuple[Column, float]], mean: bool = True) -> Column:
    total = sum((s * w for s, w in scores), F.lit(0.0))
    return total / len(scores) if mean else total


def link_score(u: Column, text: Column, title: Column, css: Column, rel: Column) -> Column:
    """How much a link promises by its attributes, address and wording: 0 to 10."""
    lit = lambda c: F.lower(F.coalesce(c, F.lit("")))
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    low, t = F.lower(u), F.trim(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) - 2
    total = add(F.length(F.trim(F.coalesce(title, F.lit("")))) > 3, 1.0) + add(lit(css).rlike("nav|menu|primary|main|important"), 1.5) - add(lit(css).rlike("ad|sponsor|track|promo|banner"), 1.0)
    total += add(lit(rel).rlike("canonical|next|prev|chapter"), 1.0) - add(lit(rel).rlike("nofollow|sponsored|ugc"), 0.5)
    total += F.when(low.rlike("/(?:docs|api|guide|tutorial|reference|manual)/"), 2.0).when(low.rlike("/(?:blog|article|post|news)/"), 1.0).otherwise(0.0)
    total += F.when(slashes <= 2, 1.0).when(slashes > 5, -0.5).otherwise(0.0) - add(low.rlike("/(?:admin|login|cart|checkout|track|click)/"), 1.5) + add(u.startswith("https://"), 0.5)
    total += add(F.length(t) > 3, 1.0) + add(words >= 2, 0.5) + add(words >= 4, 0.5) - add(F.lower(t).isin(*"here|link|more info|read more|click here".split("|")), 1.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(10.0))


def total_link_score(intrinsic: Column, contextual: Column) -> Column:
    """70 parts intrinsic, 30 contextual where there is one; 0 to 10."""
    both = 0.7 * intrinsic + 0.3 * F.least(contextual * 10, F.lit(10.0))
    return F.least(F.greatest(F.when(contextual.isNull(), intrinsic).otherwise(both), F.lit(0.0)), F.lit(10.0))


def url_relevance(terms: list[str], u: Column) -> Column:
    """Share of terms that occur in the url's words."""
    parts = F.filter(F.split(F.lower(u), r"[^a-z0-9]+"), lambda x: x != "")
    return sum((F.array_contains(parts, t).cast("double") for t in terms), F.lit(0.0)) / len(terms)


def seo_score(title: Column, description: Column, u: Column, keywords: list[str], canonical: Column, noindex: Column, has_jsonld: Column) -> Column:
    """Seven weighted signs of a well-kept page, 0 to 1."""
    n, m = F.length(title), F.length(description)
    by_title = F.when(n.between(50, 60), 1.0).when(n.between(40, 49) | n.between(61, 70), 0.7).otherwise(0.3)
    hits = sum((F.contains(F.lower(title), F.lit(k.lower())).cast("double") for k in keywords), F.lit(0.0))
    by_meta = F.when(m.between(140, 160), 1.0).when(m.between(120, 200), 0.5).otherwise(0.2)
    by_canonical = F.when(canonical.isNull() | (canonical == ""), 0.5).when(canonical == u, 1.0).otherwise(0.2)
    quality = F.when(F.length(path(u)) > 80, 0.7).otherwise(1.0) * F.when(path(u).rlike(r"\d{4}"), 0.8).otherwise(1.0) * F.when(query(u) != "", 0.6).otherwise(1.0) * F.when(F.contains(path(u), F.lit("_")), 0.9).otherwise(1.0)
    return 0.15 * by_title + 0.18 * F.least(0.3 * hits, F.lit(1.0)) + 0.12 * by_meta + 0.10 * by_canonical + 0.20 * (~noindex).cast("double") + 0.10 * has_jsonld.cast("double") + 0.15 * quality
