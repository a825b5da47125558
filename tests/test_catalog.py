import pytest
from oracle import same

from webloom.plans import catalog, content


@pytest.mark.parametrize("name", sorted(content.SQL))
def test_matches_sql(spark, sf, name):
    same(spark, sf, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(content.QUERIES) - set(content.SQL)))
def test_rows(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns
    df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['webloom.llm'] = None\nimport __spark_entry__ as e\nassert e.llm is None and 'url_normalize' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests", 1)[0])


def test_backfill_searches_all_rows_for_every_query(spark, tmp_path):
    rows = [(i, [1.0, i / 100]) for i in (0, 1, 2, 50, 100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["q"], r["vec_id"]) for r in catalog.QUERIES["cosine_filter_backfill"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in (0, 50, 100) for b in (0, 1, 2, 50, 100) if a != b}
