"""Links of pages: extraction, classification, deduplication, joins with head data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, quoted or bare; the empty string without it."""
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']?([^"'>\s]*)""", 1)


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, pos, href as written, text, target: normalised absolute URL, kind: internal or external) of every anchor. JVM only: one pass of a regular expression, no parse."""
    # The end of an anchor isn't needed to find it; broken markup still gives its links.
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>[^<]*"), F.lit(0))
    rows = pages.select(key, F.col(url).alias("url"), F.posexplode(found).alias("pos", "a"))
    href = attribute(F.col("a"), "href")
    text = F.trim(F.regexp_extract("a", r"(?s)>(.*)$", 1))
    target = U.normalise(U.resolve(F.col("url"), href))
    out = rows.where(href != "").select(key, "url", "pos", href.alias("href"), text.alias("text"), target.alias("target"))
    return out.withColumn("kind", F.when(U.is_external(F.col("target"), U.base_domain(F.col("url"))), "external").otherwise("internal"))


def first_links(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Of equal targets on a page, the first; by partial aggregation."""
    rest = [c for c in links.columns if c not in (key, "kind", "target", "pos")]
    first = links.groupBy(key, "kind", "target").agg(F.min(F.struct("pos", *rest)).alias("_m"))
    return first.select(key, "kind", "target", "_m.*").select(*links.columns)


def followable(links: DataFrame, include_external: bool = False, excluded: Column | None = None, key: str = "page_id") -> DataFrame:
    """(key, target, pos) of what a traversal may follow: internal links, and external ones if asked for, whose base domain isn't excluded; each target once."""
    inner, outer = links.where("kind = 'internal'"), links.where("kind = 'external'")
    if excluded is not None:
        outer = outer.where(~F.array_contains(excluded, U.base_domain(F.col("target"))))
    both = inner.unionByName(outer) if include_external else inner
    return both.groupBy(key, "target").agg(F.min("pos").alias("pos"))


def by_relevance(links: DataFrame, relevance: str = "relevance", key: str = "page_id") -> DataFrame:
    """links with their rank on the page: by relevance where any link of the page has one (those without last), else in page order; ties in page order."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(relevance), "pos")
    return links.withColumn("rank", F.row_number().over(w))


def preview_filter(links: DataFrame, include: list[str] = (), exclude: list[str] = (), most: int = 10, key: str = "page_id") -> DataFrame:
    """Links that match a pattern (if any is given) and none of those excluded; the first `most` of a page; then each target once."""
    ok = U.any_of(U.glob(F.col("target"), p) for p in include) if include else F.lit(True)
    bad = U.any_of(U.glob(F.col("target"), p) for p in exclude)
    w = W.partitionBy(key).orderBy("pos")
    cut = links.where(ok & ~bad).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return cut.groupBy(key, "target").agg(F.min("pos").alias("pos"))


def merge_heads(links: DataFrame, heads: DataFrame) -> DataFrame:
    """links ⟕ heads (url, title, relevance) on the target, with the total score."""
    joined = links.join(heads.withColumnRenamed("url", "target"), "target", "left")
    own = U.link_score(F.col("target"), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return joined.withColumn("intrinsic", own).withColumn("total", U.total_link_score(own, F.col("relevance")))


def citations(markdown: Column) -> Column:
    """array<struct<text,url,n>> of a text's inline links; n numbers the urls by first occurrence."""
    found = F.regexp_extract_all(markdown, F.lit(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), F.lit(2))
    names = F.regexp_extract_all(markdown, F.lit(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    order = F.array_distinct(found)
    return F.zip_with(names, found, lambda a, u: F.struct(a.alias("text"), u.alias("url"), F.array_position(order, u).cast("int").alias("n")))


_LINK = r"""!?\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?[^)]*\)"""


def references(markdown: Column) -> Column:
    """struct<text, references> of a text with inline links: in the text each link is its words and a number in angle brackets; the list under a heading names each url once, in the order of first occurrence, with the title and words of its first link."""

    def group(k: int) -> Column:
        return F.regexp_extract_all(markdown, F.lit(_LINK), F.lit(k))

    parts = F.struct(group(0).alias("hit"), group(1).alias("words"), group(2).alias("url"), group(3).alias("title"), F.split(markdown, _LINK, -1).alias("gap"))

    def build(p: Column) -> Column:
        def with_order(order: Column) -> Column:
            number = lambda u: F.array_position(order, u).cast("string")
            label = lambda i: F.concat(F.get(p["words"], i), F.lit("\u27e8"), number(F.get(p["url"], i)), F.lit("\u27e9"))
            own = lambda i: F.when(F.get(p["hit"], i).startswith("!"), F.concat(F.lit("!["), label(i), F.lit("]"))).otherwise(label(i))
            text = F.concat(F.array_join(F.transform(p["hit"], lambda _, i: F.concat(F.get(p["gap"], i), own(i))), ""), F.element_at(p["gap"], -1))

            def line(u: Column) -> Column:
                at = F.array_position(p["url"], u).cast("int") - 1
                title, words = F.get(p["title"], at), F.get(p["words"], at)
                said = F.array_join(F.filter(F.array(title, F.when(words != title, words)), lambda x: x.isNotNull() & (x != "")), " - ")
                return F.concat(F.lit("\u27e8"), number(u), F.lit("\u27e9 "), u, F.when(said != "", F.concat(F.lit(": "), said)).otherwise(F.lit("")), F.lit("\n"))

            return F.struct(text.alias("text"), F.concat(F.lit("\n\n## References\n\n"), F.array_join(F.transform(order, line), "")).alias("references"))

        return T.let(F.array_distinct(p["url"]), with_order)

    return T.let(parts, build)
