import pytest
from pyspark.sql import functions as F

from webloom.functions.dom import parse
from webloom.operators import adaptive, links, search
from webloom.operators import scrape as S
from webloom.plans import config
from webloom.sources.pages import PageCache, robots_allowed, union_seeds


def test_settings_round_trip():
    s = S.Selection(target=("main", "h1"), least_words=3)
    said = config.dumps({"select": s, "n": [1, None]})
    assert config.loads(said) == {"select": s, "n": [1, None]} and "only_text" not in said
    with pytest.raises(ValueError, match="unknown"):
        config.loads('{"type": "os.system", "params": {}}')
    with pytest.raises(TypeError):
        config.dumps(object())


def test_selection():
    page = "<body><p>one two three</p><pre><span> </span></pre><div><b>x <i>y</i></b> z<a href='https://www.facebook.com/a'>f</a><a href='/own'>o</a></div><form>q</form></body>"
    assert S.choose(parse(page), S.Selection(target=("p",))).html() == "<div><p>one two three</p></div>"
    assert "<span>x y</span> z" in S.choose(parse(page), S.Selection(only_text=True)).html()
    own = S.choose(parse(page), S.Selection(domains=("facebook.com",), forms=False)).html()
    assert "facebook" not in own and "/own" in own and "<form>" not in own and "<pre><span> </span></pre>" in own
    assert "<p>" not in S.choose(parse(page), S.Selection(least_words=4)).html()


def test_anchors():
    page = "<head><base href='https://b.org/x/'></head><body><a href=' y ' title='T'><b>in</b>side</a><a name=q>none</a><a href=''>empty</a></body>"
    assert S.anchors(parse(page)) == [{"pos": 0, "href": "y", "text": "inside", "title": "T", "base": "https://b.org/x/"}]


def test_lenient_selectors():
    from webloom.functions.dom import select

    n = parse("<div class=card><h2 class=name>A</h2><span class=price>5</span></div>")
    find = S.lenient(select)
    assert [x.text() for x in find(n, "section.shop > h2.name:first-child")] == ["A"]
    assert [x.text() for x in find(n, "div.box span.price")] == ["5"] and find(n, "em.none") == []


def test_references(spark):
    md = 'See [a](/x "T") and ![pic](/i.png), [b](/y) or [a](/x).'
    r = spark.createDataFrame([(md,), ("none",)], "m string").select(links.references(F.col("m")).alias("r")).collect()
    assert r[0]["r"]["text"] == "See a\u27e81\u27e9 and ![pic\u27e82\u27e9], b\u27e83\u27e9 or a\u27e81\u27e9."
    assert r[0]["r"]["references"] == "\n\n## References\n\n\u27e81\u27e9 /x: T - a\n\u27e82\u27e9 /i.png: pic\n\u27e83\u27e9 /y: b\n"
    assert r[1]["r"]["text"] == "none"


def test_relevant_blocks_weigh_tags(spark):
    rows = [(1, i, tag, text) for i, (tag, text) in enumerate([("h1", "river report"), ("p", "the river rose"), ("p", "other words here"), ("p", "more of them"), ("p", "and the last")])]
    got = search.relevant_blocks(spark.createDataFrame(rows, "page_id int, pos int, tag string, text string"), ["river"], least=0.0).orderBy("pos").collect()
    assert got[0]["score"] > 4 * got[1]["score"] > 0 and got[2]["score"] == 0


def test_robots_groups(spark):
    rules = spark.createDataFrame([("a", "User-agent: bot\nDisallow: /x\n\nUser-agent: *\nAllow: /y/z\nDisallow: /y\n"), ("b", ""), ("c", None)], "domain string, robots_txt string")
    urls = spark.createDataFrame([("a", "http://a/x"), ("a", "http://a/y/z1"), ("a", "http://a/y/q?r"), ("a", "http://a"), ("b", "http://b/y"), ("c", "http://c/y"), ("d", "http://d/y")], "domain string, url string")
    ok = {r["url"] for r in robots_allowed(urls, rules).where("allowed").collect()}
    assert ok == {"http://a/x", "http://a/y/z1", "http://a", "http://b/y", "http://c/y", "http://d/y"}
    assert "http://a/x" not in {r["url"] for r in robots_allowed(urls, rules, "bot").where("allowed").collect()}


def test_seed_union(spark):
    a, b = spark.createDataFrame([("u", 3), ("v", 1)], "url string, pos long"), spark.createDataFrame([("u", 0), ("w", 0)], "url string, pos long")
    assert sorted(map(tuple, union_seeds(a, b).collect())) == [("u", 0, 3), ("v", 0, 1), ("w", 1, 0)]


def test_state_round_trip(spark, tmp_path):
    d = adaptive.Digest(spark.createDataFrame([("a", 0)], "url string, step int"), [{"step": 0, "confidence": 0.5}], "rounds")
    adaptive.save_state(d, str(tmp_path))
    back = adaptive.load_state(spark, str(tmp_path))
    assert back.history == d.history and back.reason == "rounds" and back.pages.collect() == d.pages.collect()


def test_cache_goes_on_from_a_finished_stage(spark, tmp_path):
    cache = PageCache(spark, str(tmp_path / "c"), buckets=2)
    rows = lambda *r: spark.createDataFrame(list(r), "url string, ts int, html string")
    cache.upsert(rows(("u", 1, "a"), ("v", 1, "b")))
    publish, cache._publish = cache._publish, lambda: None
    cache.upsert(rows(("u", 2, "new")))  # it ends before the stage is brought in
    cache._publish = publish
    cache.upsert(rows(("w", 1, "c")))
    assert {(r["url"], r["html"]) for r in cache.table().collect()} == {("u", "new"), ("v", "b"), ("w", "c")}
    assert not (tmp_path / "c.stage").exists()


def test_features_of_a_stream(spark, tmp_path):
    from webloom.streaming.results import scrape_stream

    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    for k in range(2):
        spark.createDataFrame([(k, f"<h1>Page {k}</h1>")], "page_id long, html string").write.mode("append").parquet(where[0])
        scrape_stream(spark, *where).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(where[1]).collect())) == [(0, "# Page 0"), (1, "# Page 1")]


def test_assembly(spark):
    from webloom.sources.pages import assemble

    files = spark.createDataFrame([("10_b.md", "B"), ("2_a.md", "A"), ("2_a.xs.md", "a"), ("2_a.q.md", "q"), ("x.md", "X"), ("3_c.xs.md", "c")], "name string, text string")
    assert [r["name"] for r in assemble(files).collect()] == ["2_a.md", "10_b.md"]
    assert [r["name"] for r in assemble(files, condensed=True).collect()] == ["2_a.xs.md", "3_c.xs.md", "10_b.md"]
    assert [r["name"] for r in assemble(files, ["B"]).collect()] == ["10_b.md"]


@pytest.mark.parametrize("name", "chunk_md_sections content_selection extract_fields fit_markdown markdown markdown_references only_text page_blocks page_context page_metadata prune_content scrape_clean_html".split())
def test_references_that_are_cut_off(spark, tmp_path, name):
    """F2 to F12, F14: a title of sixty characters ends within a reference."""
    import duckdb

    import __spark_entry__ as entry

    rows = []
    for i, end in enumerate(["&", "&a", "&am", "&amp", "&amp;", "&amp;&amp", "&copy"]):
        said = f"Bleiner the&amp;&amp;&amp; ores anndenti{end}"
        rows.append((i, f"https://blog.x.example.com/en/{i}", f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{said}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Zu und. Die und der zu dem.</div><article><h1>{said}</h1><p><b>{said} of the long words that stand here.<br><p>Some more{end} and more of it.</p></article><footer>&copy; x &middot; 12 of it</footer></body></html>'))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)


def test_batches_are_worked_on_in_parts(spark, monkeypatch):
    """no more than PART bytes of html at once, no page lost, nulls and long pages too."""
    import pyarrow as pa

    pages = [None, "", "<p>é</p>", "x" * 50, *["<p>one</p>"] * 9, None]
    batch = pa.record_batch({"k": pa.array(range(len(pages))), "html": pa.array(pages, pa.string())})
    parts = list(S._parts(batch, 25))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or sum(len((h or "").encode()) for h in p.column(1).to_pylist()[:-1]) <= 25 for p in parts) and len(parts) > 4
    assert not list(S._parts(batch.slice(0, 0)))
    seen = []
    monkeypatch.setattr(S, "PART", 25)
    monkeypatch.setattr(S, "features_of", lambda h, *a: seen.append(h) or {"blocks": []})

    class Frame:
        schema = spark.createDataFrame([(1, "")], "page_id int, html string").schema
        select = lambda self, *a: self
        mapInArrow = lambda self, run, ddl: run(iter([pa.record_batch({"page_id": pa.array(range(len(pages)), pa.int32()), "html": pa.array(pages, pa.string())})]))

    monkeypatch.setattr(S, "spread", lambda df: df)
    out = S.scrape(Frame(), ["blocks"])
    assert (first := next(out).num_rows) == len(seen) < len(pages)
    assert first + sum(b.num_rows for b in out) == len(pages) and seen == pages


def test_references_as_browsers_read_them():
    page = "<h1>a&amp b &am</h1>"
    assert parse(page).text() == "a& b &am" and parse(page).html() == "<h1>a&amp; b &amp;am</h1>"
    assert parse(page, closed=True).text() == "a&amp b &am" and parse(page, closed=True).html() == page
