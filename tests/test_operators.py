import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import frontier, links, search, vectors
from webloom.sources import pages as P
from webloom.streaming import telemetry as M


def test_links(spark):
    html = '<a href="/b/?utm_source=x">B</a><a href=/b>B2</a><a href="https://o.com/q">O</a><a name=x>no</a><a href="mailto:a@b.c">m'
    got = links.extract_links(spark.createDataFrame([(1, "https://www.a.org/x", html), (2, "https://a.org/", None)], "page_id long, url string, html string"))
    rows = {(r["target"], r["kind"]) for r in got.collect()}
    assert ("https://www.a.org/b", "internal") in rows and ("https://o.com/q", "external") in rows
    assert links.first_links(got).where("kind = 'internal'").count() == 1


def test_citations(spark):
    md = "see [a](http://x) and [b](http://y \"t\") and ![i](z.png) and [c](http://x)"
    got = spark.range(1).select(links.citations(F.lit(md)).alias("c")).first()["c"]
    assert [(r["text"], r["url"], r["n"]) for r in got] == [("a", "http://x", 1), ("b", "http://y", 2), ("c", "http://x", 1)]


EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f")]


def test_traversals(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    s = spark.createDataFrame([("a",)], "url string")
    assert {(r["url"], r["depth"]) for r in frontier.bfs(e, s, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert frontier.bfs(e, s, 5, max_pages=3).count() == 3
    assert {r["url"] for r in frontier.bfs(e, s, 5, score=F.when(F.col("url") == "b", 0.0).otherwise(1.0), threshold=0.5).collect()} == {"a", "c", "d", "e", "f"}
    assert [r["url"] for r in frontier.dfs(e, s, 5).orderBy("pos").collect()] == ["a", "b", "d", "e", "f", "c"]
    best = frontier.best_first(e, s, F.ascii("url").cast("double"), max_pages=4, batch=1).orderBy("batch").collect()
    assert [r["url"] for r in best] == ["a", "c", "d", "e"]
    with pytest.raises(ValueError, match="depth-first"):
        frontier.dfs(e, s, 5, max_pages=2)


def test_dfs_of_any_size(spark):
    """cyclic graphs under a bound of depth against recursion, without a bound of pages; a tree of two million pages in order."""
    rng = np.random.default_rng(3)
    for depth in (0, 2, 4, 50):
        pairs = [(f"p{a}", f"p{b}") for a, b in rng.integers(0, 40, (90, 2))]
        kids = {}
        for a, b in pairs:
            kids.setdefault(a, set()).add(b)
        want, seen = [], set()

        def visit(u, parent, d):
            if u not in seen:
                seen.add(u)
                want.append((u, parent, d, len(want)))
                for v in sorted(kids.get(u, ())) if d < depth else ():
                    visit(v, u, d + 1)

        for root in ("p3", "p7"):
            visit(root, None, 0)
        got = frontier.dfs(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("p7",), ("p3",)], "url string"), depth, max_pages=None)
        assert sorted(map(tuple, got.select("url", "parent", "depth", "pos").collect()), key=lambda r: r[3]) == want
    n = 1 << 21
    dst = np.arange(1, n, dtype=np.int32)
    page, parent, deep = frontier._walk([0], (dst - 1) // 2, dst, n, 60)
    assert len(page) == n and page[:22].tolist() == [(1 << k) - 1 for k in range(22)] and deep.max() == 21 and ((page[1:] - 1) // 2 == parent[1:]).all()


def test_saturation_and_coverage(spark):
    steps = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "a")], "step int, term string")
    h = search.new_terms(steps)
    assert {(r["step"], r["new_terms"]) for r in h.collect()} == {(0, 2), (1, 1), (2, 0)}
    assert search.saturation(h).first()["saturation"] == 1.0
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "doc_id long, text string")
    c = search.coverage(search.term_stats(docs), ["alpha", "nothing"], docs.agg(F.count(F.lit(1)).alias("n"))).first()["coverage"]
    assert c == pytest.approx(min(1, ((1 * 1.5 + 0) / 2) ** 0.5))
    assert search.consistency(docs).first()["consistency"] == pytest.approx(1 / 3)


def test_ward_clusters():
    d = np.array([[0, 0.1, 0.9, 0.9], [0.1, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.2], [0.9, 0.9, 0.2, 0]])
    assert vectors.ward(d, 0.3).tolist() == [0, 0, 1, 1]
    assert vectors.ward(d, 0.15).tolist() == [0, 0, 1, 2]
    assert len(set(vectors.ward(d, 5.0).tolist())) == 1


def test_sitemaps_and_robots(spark):
    maps = spark.createDataFrame(
        [
            ("https://a.org/sitemap.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in ("/s1.xml", " https://a.org/s2.xml ")) + "</sitemapindex>"),
            ("https://a.org/s1.xml", '<n:urlset xmlns:n="x"><n:url><n:loc>https://a.org/1?a=1&amp;b=2</n:loc></n:url></n:urlset>'),
            ("https://a.org/s2.xml", "<urlset><url><loc><![CDATA[https://a.org/2]]></loc></url><url><loc>three</loc></url></urlset>"),
        ],
        "url string, xml string",
    )
    assert {r["loc"] for r in P.sitemap_leaves(maps, "https://a.org/sitemap.xml").collect()} == {"https://a.org/1?a=1&b=2", "https://a.org/2", "https://a.org/three"}
    urls = spark.createDataFrame([("a.org", "https://a.org/x"), ("a.org", "https://a.org/no/x"), ("b.org", "https://b.org/no/")], "domain string, url string")
    rules = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /no/\nSitemap: https://a.org/m.xml")], "domain string, robots_txt string")
    assert {(r["url"], r["allowed"]) for r in P.robots_allowed(urls, rules).collect()} == {("https://a.org/x", True), ("https://a.org/no/x", False), ("https://b.org/no/", True)}
    assert rules.select(P.robots_sitemaps(F.col("robots_txt")).alias("s")).first()["s"] == ["https://a.org/m.xml"]


def test_files_and_cache(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>é</p>")
    assert P.read_files(spark, str(tmp_path / "p.html")).first()["html"] == "<p>é</p>"
    cache = P.PageCache(spark, str(tmp_path / "cache"), buckets=4)
    row = lambda u, t, h: (u, dt.datetime(2024, 1, t), h)
    make = lambda rows: spark.createDataFrame(rows, "url string, ts timestamp, html string")
    assert cache.count() == 0
    cache.upsert(make([row("a", 1, "old"), row("b", 1, "b")]))
    cache.upsert(make([row("a", 2, "new"), row("c", 1, "c")]))
    assert {(r["url"], r["html"]) for r in cache.table().collect()} == {("a", "new"), ("b", "b"), ("c", "c")}
    wanted = spark.createDataFrame([("a",), ("z",)], "url string")
    assert [r["url"] for r in cache.missing(wanted).collect()] == ["z"] and cache.probe(wanted).count() == 2


def test_rate_limiter(spark):
    assert M.backoff(1.0, 0, 429) == (2.0, 1, True) and M.backoff(50.0, 3, 503) == (60.0, 4, False) and M.backoff(4.0, 2, 200) == (3.0, 0, True)
    rows = [("d", dt.datetime(2024, 1, 1, 0, 0, i), s) for i, s in enumerate([429, 503, 200, 200])] + [("e", dt.datetime(2024, 1, 1), 200)]
    got = M.rate_states(spark.createDataFrame(rows, "domain string, ts timestamp, status int")).orderBy("domain", "ts").collect()
    assert [r["delay"] for r in got] == [2.0, 4.0, 3.0, 2.25, 1.0]


def test_streams(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = M.timeline(stream).writeStream.format("memory").queryName("timeline").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in M.timeline(spark.read.schema(schema).parquet(str(tmp_path / "in"))).select("start", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("timeline").select("start", "event_type", "n").collect()} == want
    status = stream.select((F.col("user_id") % 5).cast("string").alias("domain"), "ts", F.lit(200).alias("status"))
    q = M.rate_states(status).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").count() == spark.read.parquet(f"{sf}/events.parquet").count()
    q = M.unseen(stream, "user_id", "ts").select("user_id").writeStream.format("memory").queryName("users").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("users").count() == spark.table("users").distinct().count()
