from webloom.functions.dom import parse, select, xpath
from webloom.operators import scrape as S

ARTICLE = """<html lang=en><head><title> A title </title><meta name=description content="About it"><meta property="og:type" content=article><link rel=canonical href="/c"></head>
<body><nav><a href=/a>menu</a><a href=/b>more</a></nav><article><h1>Head</h1><p>First <b>bold</b> words, and <a href="/x" title="T">a link</a>.<p>Second &amp; last<br>line.</article>
<ul><li>one<li>two<ul><li>inner</ul></ul><table><thead><tr><th>k<th>v</thead><tbody><tr><td>a<td>1<tr><td colspan=2>b</tbody></table>
<div class="x y" id=z data-k=v></div><script>var a = "</p>"</script><footer>foot</footer></body>"""


def test_tree():
    root = parse(ARTICLE)
    assert [p.text(" ") for p in root.all("p")] == ["First bold words, and a link .", "Second & last line."]
    assert len(select(root, "ul > li")) == 3 and len(select(root, "body > ul > li")) == 2
    assert [n.tag for n in select(root, "div.x.y#z[data-k='v'], article h1")] == ["h1", "div"]
    assert select(root, "article p:nth-child(2)")[0].text().startswith("First")
    assert len(xpath(root, "//table//tr")) == 3 and xpath(root, "//div[contains(@class,'y')]")[0].attrs["id"] == "z"
    assert parse(None).text() == "" and parse("<p <b").text() == "" and parse("a" * 10 + "<div>" * 3000).text() == "a" * 10


def test_features():
    f = S.features_of(ARTICLE, S.FEATURES)
    assert f["metadata"]["title"] == "A title" and f["metadata"]["description"] == "About it" and f["metadata"]["lang"] == "en" and f["metadata"]["og:type"] == "article"
    assert f["page_query"] == "A title Head About it"
    assert f["tables"][0]["headers"] == ["k", "v"] and f["tables"][0]["rows"] == [["a", "1"], ["b", "b"]]
    assert "script" not in f["cleaned_html"] and 'class="x' not in f["cleaned_html"] and 'href="/x"' in f["cleaned_html"]
    assert [b["text"] for b in f["blocks"]][:3] == ["menumore", "Head", "First bold words, and a link."]
    m = f["markdown"]
    assert "# Head" in m and "First **bold** words, and [a link](/x \"T\")." in m and "* one" in m and "| k | v |" in m
    assert "menu" not in f["fit_markdown"] and "foot" not in f["fit_markdown"] and "First" in f["fit_markdown"]


def test_empty_and_broken_pages():
    for page in (None, "", "<", "<table><tr>", "<p><b>x<br><p>y", "text only"):
        f = S.features_of(page, S.FEATURES)
        assert isinstance(f["markdown"], str)
    assert S.features_of("<p><b>x<br><p>y", ["blocks"])["blocks"] == [{"pos": 0, "tag": "p", "text": "x"}, {"pos": 1, "tag": "p", "text": "y"}]


def test_layout_tables_and_small_images_are_left_out():
    assert S.tables(parse("<table role=presentation><tr><td>a</table>")) == []
    page = '<p><img src="a.jpg" alt=x width=300 height=200></p><p><img src="logo.png" alt=logo width=300 height=200></p><p><img src=t.gif></p>'
    assert [m["src"] for m in S.media(parse(page))] == ["a.jpg"]


def test_extraction(spark):
    html = '<div class=p><h2> A </h2><span class=c>$ 12.50</span><ul><li>x<li>y</ul></div><div class=p><h2>B</h2></div>'
    fields = [
        dict(name="name", type="text", selector="h2", transform="lowercase"),
        dict(name="price", type="regex", selector=".c", pattern=r"([0-9.]+)", default="0"),
        dict(name="items", type="list", selector="li", fields=[dict(name="v", type="text")]),
        dict(name="n", type="computed", expression="size(items)"),
    ]
    schema = {"baseSelector": "div.p", "fields": fields}
    got = S.extract(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), schema).orderBy("pos").collect()
    assert [(r["page_id"], r["name"], r["price"], [i["v"] for i in r["items"]], r["n"]) for r in got] == [(1, "a", "12.50", ["x", "y"], 2), (1, "b", "0", [], 0)]
