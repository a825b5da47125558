import pytest
from pyspark.sql import functions as F

from webloom.functions import urls as U


def values(spark, build, *args):
    """The value of an expression over string literals."""
    return spark.range(1).select(build(*[F.lit(a) for a in args]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://a.org/x/y.html", "z", "https://a.org/x/z"),
        ("https://a.org/x/y/", "../z?b=1", "https://a.org/x/z?b=1"),
        ("https://a.org/x/y/w", "../../../z", "https://a.org/z"),
        ("https://a.org", "z", "https://a.org/z"),
        ("https://a.org/x", "/r", "https://a.org/r"),
        ("https://a.org/x", "//b.org/r", "https://b.org/r"),
        ("https://a.org/x?q=1", "?p=2", "https://a.org/x?p=2"),
        ("https://a.org/x", "#t", "https://a.org/x#t"),
        ("https://a.org/x", "mailto:a@b.c", "mailto:a@b.c"),
        ("https://a.org/x", "  ", None),
        ("https://a.org/x", "", None),
    ],
)
def test_resolve(spark, base, href, want):
    assert values(spark, U.resolve, base, href) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://A.org/X/", "https://a.org/X"),
        ("https://a.org/", "https://a.org/"),
        ("https://a.org", "https://a.org"),
        ("https://a.org/x?b=2&A=1&utm_source=f#t", "https://a.org/x?a=1&b=2"),
        ("https://a.org/x?b=2&b=1", "https://a.org/x?b=2&b=1"),
        ("https://a.org/x?ref=r", "https://a.org/x"),
        ("https://a.org/x?flag", "https://a.org/x?flag="),
    ],
)
def test_normalise(spark, url, want):
    assert values(spark, U.normalise, url) == want
    assert values(spark, U.normalise, want) == want


@pytest.mark.parametrize(("url", "want"), [("https://www.a.b.org/x", "b.org"), ("http://x.co.uk:80/", "x.co.uk"), ("http://a.b.co.uk", "b.co.uk"), ("http://localhost/x", "localhost"), ("https://m.x.example.com", "example.com")])
def test_base_domain(spark, url, want):
    assert values(spark, U.base_domain, url) == want


@pytest.mark.parametrize(
    ("url", "base", "external"),
    [("mailto:a@b.c", "a.org", True), ("/x", "a.org", False), ("https://www.a.org/", "a.org", False), ("https://sub.a.org", "a.org", False), ("https://nota.org", "a.org", False), ("https://b.com", "a.org", True)],
)
def test_external(spark, url, base, external):
    assert values(spark, U.is_external, url, base) is external


def test_external_at_a_dot(spark):
    assert values(spark, lambda u, b: U.is_external(u, b, dotted=True), "https://nota.org", "a.org") is True


@pytest.mark.parametrize(("url", "want"), [("https://a.org/2023/01/x", 2023), ("https://a.org/a-2019-b_2021", 2021), ("https://a.org/2031/", None), ("https://a.org/x2020", None)])
def test_year(spark, url, want):
    assert values(spark, U.year, url) == want


@pytest.mark.parametrize(("url", "want"), [("https://a.org/x.HTML", True), ("https://a.org/x", True), ("https://a.org/x.pdf", False), ("https://a.org/x.unknown", False)])
def test_content_type(spark, url, want):
    assert values(spark, lambda u: U.content_type_allowed(u, ["text/html"]), url) is want


@pytest.mark.parametrize(("url", "want"), [("https://a.org/", True), ("https://s.a.org/", True), ("https://bad.a.org/", False), ("https://xa.org/", False)])
def test_domains(spark, url, want):
    assert values(spark, lambda u: U.domain_allowed(u, ["a.org"], ["bad.a.org"]), url) is want


@pytest.mark.parametrize(("url", "want"), [("https://a.org/robots.txt", True), ("https://a.org/sitemap-1.xml.gz", True), ("https://a.org/.git/x", True), ("https://a.org/login", True), ("https://a.org/x?print=1", True), ("https://a.org/ab", True), ("https://a.org/en", False), ("https://a.org/article", False)])
def test_nonsense(spark, url, want):
    assert values(spark, U.is_nonsense, url) is want


def test_scores(spark):
    assert values(spark, lambda u: U.depth_score(u, 2), "https://a.org/a/b") == 1.0
    assert values(spark, U.freshness_score, "https://a.org/2020/x") == pytest.approx(0.6)
    assert values(spark, U.freshness_score, "https://a.org/x") == 0.5
    assert values(spark, lambda u: U.keyword_score(u, ["Docs", "x"]), "https://a.org/docs") == 0.5
    none = F.lit(None).cast("string")
    s = values(spark, lambda u, x: U.link_score(u, x, none, F.lit("main"), F.lit("nofollow")), "https://a.org/docs/x", "a guide to it")
    assert s == pytest.approx(1.5 - 0.5 + 2 + 1 + 0.5 + 1 + 0.5 + 0.5)
    assert values(spark, lambda u: U.total_link_score(F.lit(8.0), F.lit(None).cast("double")), "") == 8.0


@pytest.mark.parametrize("name", ["score_composite", "url_scores"])
def test_page_numbers_are_no_years(spark, tmp_path, name):
    """urls whose page numbers begin as years do."""
    import duckdb

    import __spark_entry__ as entry

    urls = [f"http://{h}.example.net/en/{n}{end}" for h in ("blog.x", "tionsh") for n in (7, 1934, 2010, 19345, 201000) for end in ("", "/", ".html", "?page=2&ref=x", "#top", "/?utm_source=feed")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert [tuple(map(float, r)) for r in sorted(got)] == [tuple(map(float, r)) for r in sorted(want.fetchall())]
