import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import bpe, spans, token_store
from webloom.llm.queries import vocabulary

regex = pytest.importorskip("regex")
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
TEXTS = ["Hello, world's  best\n\n text 123½ don't 'll", None, "", " ", "\n", "aaaaaaaaaaaa", "é😀漢字 ſ'S", "x" * 5000, "the the the", "<|endoftext|> tail", "a b　c  d", "'s's've", "tab\tand  two", "the the the"]
PIECES = st.sampled_from(["'", " ", "  ", "\n", "a", "s", "t", "re", "ve", "ll", "é", "1", "½", "!", "…", " ", "　", "漢", "😀", "don't", "\r\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=8), st.integers(1, 60))
def test_pretokens(docs, limit):
    column = pa.array([*docs, None])
    for i, j, data, off in spans.chunks(column, limit):
        starts = spans.pretoken_starts(data, off)
        ends = np.append(starts[1:], len(data))
        got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends[: len(starts)], strict=True)]
        assert got == [m for d in [*docs, ""][i:j] for m in PATTERN.findall(d)]


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN.pattern, mergeable_ranks=bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_merge_replay(encoding, docs):
    table = bpe.WordTable(_replay(encoding).encode)
    assert [x.tolist() for x in table.encode_column(pa.array(docs, pa.string()))] == [encoding.encode_ordinary(d) for d in docs]


_made = []


def _replay(encoding):
    if not _made:
        _made.append(bpe.MergeReplay(encoding._mergeable_ranks))
    return _made[0]


def test_round_trip(spark, sf, encoding):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("x", "y")
    v = vocabulary("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs, v).collect()}
    for i, t in enumerate(TEXTS):
        ids = encoding.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs, v), v).collect()
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.digests(docs.limit(0), v).count() == 0
    clash = spark.createDataFrame([(None, "a b", "x", 1), (3, "a b", "y", 2), (3, "a b", "y", 2), (4, None, None, None)], "doc_id long, text string, n_tokens string, ids int")
    assert [r["n_tokens"] for r in bpe.digests(clash, v).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [2, 2, 2, 0]
    assert sorted(len(r["ids"]) for r in bpe.encode(clash, v).collect()) == [0, 2, 2, 2]


def test_whole_table_against_tiktoken(spark, sf, encoding):
    from webloom.llm import queries

    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for doc, x in map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        ids = encoding.encode_ordinary(x or "")
        assert got[doc] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())


def test_repair_and_random_access():
    r = np.random.default_rng(1)
    ids = np.concatenate([np.tile([5, 6, 7, 8], 300), r.integers(0, 50, 4000), np.full(500, 9)]).astype(np.int32)
    cuts = np.unique(np.append(r.integers(0, len(ids), 40), len(ids)))
    ends = np.concatenate([cuts[:5], cuts[4:5], cuts[5:]])  # with an empty document
    shard = token_store.Shard(token_store.shard_bytes(np.arange(len(ends)), np.arange(len(ends)) != 3, ids, ends, 60))
    assert np.flatnonzero(~shard.named).tolist() == [3]
    assert len(shard.seq) < len(ids) and (shard.all() == ids).all()
    for i, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        assert shard.document(i).tolist() == ids[a:z].tolist()
    for a, z in ((0, 1), (1199, 1203), (17, 4000), (len(ids) - 1, len(ids) + 9), (5, 5)):
        assert shard.ids(a, z).tolist() == ids[a:z].tolist()
    with pytest.raises(ValueError, match="shard"):
        token_store.Shard(b"nothing")


def test_repair_goes_on_while_pairs_repeat():
    ids = np.tile(np.arange(64), 400).astype(np.int32)
    seq, rules, _ = token_store.repair(ids, np.array([len(ids)]), 64)
    assert len(seq) <= 402 and max(map(len, token_store.expansions(rules, 64))) >= 64
    assert (token_store.expand(seq, token_store.expansions(rules, 64), 64) == ids).all()
    wide = np.random.default_rng(4).integers(0, 3, 60_000).astype(np.int32)  # more than 2**16 symbols
    shard = token_store.Shard(token_store.shard_bytes(np.zeros(1), np.ones(1, bool), wide, np.array([len(wide)]), 65_530))
    assert shard.seq.max() >= 1 << 16 and (shard.all() == wide).all()


def test_token_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rows = [*((7 * i % 101, x) for i, x in enumerate(TEXTS * 3)), (None, "no key <|endoftext|>")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, n_tokens int").repartition(5)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.round_trip(docs, path).collect())
    start = 0
    for (at, doc, n, crc), (i, x) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert (at, doc, n, crc) == (start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.round_trip(docs.limit(0), path).count() == 0


def test_whole_table_against_the_library(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    from webloom.llm import queries

    t = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op7_token_store(spark, sf).collect()}
    start = 0
    for doc, x in sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_other_vocabularies_go_to_the_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rows = list(enumerate(["Hello WORLD", None, "a  b", ""]))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def thue_morse(n: int = 10) -> tuple[str, str]:
    """A word and its complement, which polynomial hashes modulo 2**64 don't tell apart."""
    w = [bin(k).count("1") & 1 for k in range(1 << n)]
    return "".join("ab"[x] for x in w), "".join("ba"[x] for x in w)


def test_words_that_weak_hashes_confuse(spark, encoding):
    x, y = thue_morse()
    rows = list(enumerate([x, y, f"{y} {x}"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    v = vocabulary("byte_bpe_multi_50k.tiktoken")
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(bpe.encode(docs, v), v).collect()} == dict(rows)
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["ids_crc32"] for r in token_store.round_trip(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert got == {i: zlib.crc32(np.array([*t.encode(w, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, w in rows}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=6))
def test_words_of_one_hash(encoding, docs):
    table = bpe.WordTable(_replay(encoding).encode)
    docs = [*docs, *thue_morse(7), "the other words"]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "span_hashes", lambda data, a, z: np.full(len(a), 7, np.uint64))
        assert [x.tolist() for x in table.encode_column(pa.array(docs * 2, pa.string()))] == [encoding.encode_ordinary(d) for d in docs * 2]


def test_span_hashes():
    words = [b"", b"\0", b"\0\0", b"a", b"a" * 8, b"a" * 9, b"a" * 64, b"a" * 65, *(w.encode() for w in thue_morse()), *(bytes([k]) * 17 for k in range(50))]
    data = np.frombuffer(b"".join(words) * 2, np.uint8)
    size = np.array([len(w) for w in words] * 2)
    h = spans.span_hashes(data, np.cumsum(size) - size, np.cumsum(size))
    assert len(set(h.tolist())) == len(set(words)) and (h[: len(words)] == h[len(words) :]).all()


def test_op7_matches_added_tokens(spark, tmp_path):
    from webloom.llm import queries

    t = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = list(enumerate([*TEXTS, "a <|endoftext|><|endoftext|>  b", "<|endoftext|>", "it's<|endoftext|>s <|endoftext"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op7_token_store(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
