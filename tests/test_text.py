import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import vectors as V


def val(spark, build, *args):
    return spark.range(1).select(build(*[F.lit(a) for a in args]).alias("v")).first()["v"]


def test_chunkers(spark):
    words = " ".join(f"w{i}" for i in range(230))
    assert [len(c.split()) for c in val(spark, T.chunk_fixed, words)] == [100, 100, 30]
    slid = val(spark, T.chunk_sliding, words)
    assert [c.split()[0] for c in slid] == ["w0", "w50", "w100", "w130"] and all(len(c.split()) == 100 for c in slid)
    over = val(spark, lambda c: T.chunk_overlapping(c, 100, 20), words)
    assert [c.split()[0] for c in over] == ["w0", "w80", "w160"] and over[-1].split()[-1] == "w229"
    assert val(spark, T.chunk_sliding, "  short  text ") == ["  short  text "]
    assert val(spark, T.chunk_fixed, "") == []
    assert val(spark, T.chunk_regex, "a\n\nb\n\n\n\nc") == ["a", "b", "", "c"]
    assert val(spark, T.chunk_sentences, "One. Two!  One. Three") == ["One.", "Two!", "Three"]
    assert val(spark, T.chunk_markdown, "x\n# A\ny\n## B\nz") == ["x\n", "# A\ny\n", "## B\nz"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=1, max_size=400), st.integers(5, 60))
def test_overlapping_covers(spark, ids, size):
    words = [f"w{i}x{v}" for i, v in enumerate(ids)]
    got = val(spark, lambda c: T.chunk_overlapping(c, size, size // 3), " ".join(words))
    seen = [w for c in got for w in c.split()]
    assert set(seen) == set(words)


def test_entities(spark):
    got = {(r["label"], r["value"]) for r in val(spark, T.entities, "a@b.co on 2024-01-02 #tag 50% 10.0.0.1 #a1b2c3 DE44500105175407324931")}
    assert {("email", "a@b.co"), ("date_iso", "2024-01-02"), ("hashtag", "#tag"), ("percentage", "50%"), ("ipv4", "10.0.0.1"), ("html_color_hex", "#a1b2c3"), ("iban", "DE44500105175407324931")} <= got


def test_small_functions(spark):
    assert val(spark, T.text_key, "A b-C é") == "abc"
    assert val(spark, lambda c: T.xml_tag(c, "b"), "<b>x</b><b> longer </b>") == "longer"
    assert val(spark, lambda c: T.xml_tag(c, "b"), "none") is None
    assert [tuple(r) for r in val(spark, T.srcset, "a.jpg 100w, b.jpg")] == [("a.jpg", 100), ("b.jpg", None)]
    assert spark.range(1).select(T.duration(F.lit(3725)).alias("v")).first()["v"] == "1:02:05"
    assert val(spark, T.proxy, "1.2.3.4:80:u:p")["server"] == "http://1.2.3.4:80"
    assert str(val(spark, T.pdf_date, "D:20240102030405Z")) == "2024-01-02 03:04:05"
    assert val(spark, T.escape_markdown, "a*b_c") == r"a\*b\_c"
    assert val(spark, lambda a: T.jaccard(T.trigrams(a), T.trigrams(a)), "hello") == 1.0


def test_cosine(spark):
    one = spark.range(1).select(V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("v"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert one["v"] == pytest.approx(0.5**0.5) and one["z"] == 0.0
