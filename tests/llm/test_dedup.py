import random

from brute import near
from oracle import same

from webloom.llm import exact_dedup, near_dedup, queries
from webloom.llm.components import components


def texts():
    r = random.Random(3)
    vocab = [f"W{k}" if k % 5 == 0 else f"w{k}" for k in range(300)]
    out = []
    for g in range(14):
        base = [r.choice(vocab) for _ in range(r.choice([4, 6, 30, 120]))]
        for _ in range(r.choice([1, 2, 25])):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 18))):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append(" ".join(t))
    out += [None, "", " \n\t", "a b", "A  B", "c", "one two three", out[0], out[0].upper()]
    chain = [f"c{k}" for k in range(60)]
    out += [" ".join(chain[3 * k : 3 * k + 36]) for k in range(8)]
    return list(enumerate(out, 100))


def test_near_duplicates(spark, words=5):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, words).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in near(rows, words).items()}


def test_mixed_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    r = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(w if r.random() > 0.035 else f"x{r.randrange(999)}" for w in base)) for i in range(60)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in near(rows, 4).items()}


def test_mixed_buckets_of_many_sizes(spark, monkeypatch):
    """Texts that share much but link only where they are of like size."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    r = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join([w if r.random() > 0.02 else f"x{r.randrange(9999)}" for w in base[: r.choice([60, 70, 80, 100, 130, 160, 200, 250, 330, 400])]])) for i in range(70)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in near(rows, 4).items()}


def test_near_whole_table(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in queries.op2_minhash_dedup(spark, sf).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in near(rows, 4).items()}


def test_near_words_that_weak_hashes_confuse(spark):
    w = [bin(k).count("1") & 1 for k in range(1024)]
    x, y = "".join("ab"[k] for k in w), "".join("ba"[k] for k in w)
    rows = [(1, " ".join([x] * 4)), (2, " ".join([y] * 4))]
    assert {r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()} == {1, 2}


def test_rows_without_a_key(spark):
    schema = "doc_id long, text string, keep_id string, digest int"
    rows = [(None, "a b c d e", "x", 1), (3, "a  b c d e", "x", 1), (None, "other", "x", 1), (None, "other", "x", 1), (None, None, "x", 1), (5, "alone", "x", 1)]
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.grouped(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([(0, 3, 2, False), (3, 3, 2, True), (0, 0, 2, True), (0, 0, 2, True), (0, 0, 1, True), (5, 5, 1, True)])
    near_ = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, schema), 4).collect())
    assert near_ == sorted([(0, 3, False), (3, 3, True), (0, 0, True), (0, 0, True), (0, 0, True), (5, 5, True)])
    assert exact_dedup.grouped(spark.createDataFrame([], schema)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_large_groups_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 5)
    rows = [(i, "hot" if i % 3 else f"t{i // 6}") for i in range(60)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (min(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows}


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from webloom.llm.common import shared_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session(master))


def test_near_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (None, "a b c d e f"), (3, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {r["component_id"] for r in got} == {1, 2, 3}
    assert {r["doc_id"] for r in near_dedup.dedup(spark.createDataFrame([r for r in rows if r[0]], schema)).collect()} == {1, 2, 3}


def test_near_dedup_with_null_and_repeated_keys(spark):
    schema = "doc_id long, text string, x string"
    left, right = (" ".join(f"{c}{k}" for k in range(40)) for c in "lr")
    rows = [(5, left, "a"), (5, right, "b"), (3, f"{left} end", "c"), (9, f"{right} end", "d"), (5, left.upper(), "e"), (7, None, "f"), (7, "", "g"), (8, " ", "h")]
    none = [(None, left, "n1"), (None, "other words of no key", "n2"), (None, None, "n3"), (None, right, "n4")]
    got = near_dedup.dedup(spark.createDataFrame(rows + none, schema))
    assert got.columns == ["doc_id", "text", "x"]
    kept = {r["x"] for r in got.collect()}
    assert {"c", "b", "h", "n1", "n2", "n3", "n4"} <= kept and len(kept & {"f", "g"}) == 1 and not kept & {"a", "d", "e"}
    single = near_dedup.dedup(spark.createDataFrame([rows[0], rows[2], rows[3], *none], schema))
    assert {r["x"] for r in single.collect()} == {"c", "d", "n1", "n2", "n3", "n4"}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: root(x) for x in parent if x not in loops}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_matches_sql(spark, sf):
    same(spark, sf, queries.op4_exact_dedup, queries.OP4_SQL)


def test_digest_index(spark, tmp_path):
    schema = "doc_id long, text string, digest string"
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = spark.createDataFrame([(2, "a  b", "x"), (1, "a\tb", "x"), (3, None, "x"), (4, "", "x")], schema)
    assert {r["doc_id"] for r in index.absorb(first).collect()} == {1, 3}
    assert {r["doc_id"] for r in index.absorb(spark.createDataFrame([(9, "a b", ""), (8, "new", "")], schema)).collect()} == {8}
    assert index.table().count() == 3
    plan = index.unseen(index.table().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_exact_dedup(spark):
    schema = "doc_id long, text string, _digest string, keep_id long"
    rows = [(2, "a", "p", 0), (1, "a ", "q", 0), (1, "a ", "q", 0), (3, None, "r", 0), (4, "", "s", 0), (5, "b", "t", 0), (6, "a\n", None, 0), (None, "n", "u", 0)]
    got = exact_dedup.dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == sorted([(2, "a"), (1, "a "), (3, None), (5, "b"), (-1, "n")], key=lambda r: (r[0], r[1] or ""))
    unique = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in exact_dedup.dedup(unique).collect()} == {1, 3}
    assert exact_dedup.dedup(unique.limit(0)).count() == 0
