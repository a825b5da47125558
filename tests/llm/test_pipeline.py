import pytest
from brute import contamination, near

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from webloom.llm import bpe, exact_dedup, toxicity
    from webloom.llm.queries import vocabulary

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "decontamination", "byte_bpe"]
    kept = {}
    now = docs
    for name, f in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()} if name != "byte_bpe" else before
        now = f(spark, now, sf)
        if name != "byte_bpe":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        kept[name] = {r["doc_id"] for r in now.collect()}
        if name == "exact_dedup":
            assert len({" ".join(before[i].split()) for i in kept[name]}) == len(kept[name])
        if name == "minhash_dedup":
            assert kept[name] == {c for _, c in near(before.items(), 5).values()}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert kept[name] == {r[0] for r in contamination(before.items(), items) if not r[2]}  # no window is left
            before = {i: before[i] for i in kept[name]}
    assert kept["byte_bpe"] == kept["decontamination"]
    assert exact_dedup and bpe and toxicity and vocabulary
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == kept["byte_bpe"]


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Every stage by itself: no rows, nulls in all columns, repeated rows, a very long text, extra columns with names that are used within."""
    import pyspark.sql.functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, _key long, digest string, ids string"
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    extra = ("en", "s", 1, 0.5, True, 7, "d", "i")
    plain = [(1, "one two three four five six", *extra), (2, "one two three four five six", *extra), (3, "", *extra), (4, "word " * 60_000, *extra), (5, "long " * 40_000 + leak, *extra), (6, "you stupid moron, you idiot, worthless scum!!!", *extra)]
    rows = [*plain, plain[0], (None, None, None, None, None, None, None, None, None, None), (None, "keyless words", *extra)]
    docs = spark.createDataFrame(rows, schema)
    want = {"toxicity": {1, 2, 3, 4, 5, None}, "exact_dedup": {1, 3, 4, 5, 6, None}, "minhash_dedup": {1, 3, 4, 5, 6, None}, "decontamination": {1, 2, 3, 4, 6, None}, "byte_bpe": {1, 2, 3, 4, 5, 6, None}}
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = f(spark, docs, str(tmp_path))
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == want[name], name
        if name != "byte_bpe":
            assert got.columns == docs.columns and got.where(F.col("doc_id") == 4).first()["text"] == "word " * 60_000
