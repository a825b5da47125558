"""MinHash near-duplicates: universal hash minima in bands, signature verification, and connected components.

A document's set holds its distinct word shingles (of fewer words than one takes, the whole sequence is one; without words
the set is empty and linked with nothing). Documents are linked when the Jaccard similarity of their full sets is at least
the threshold. `BANDS` bands of `ROWS` minima miss a pair at similarity 0.8 with a chance of about 1e-7.

The work on a group follows its size, and pairs are confirmed best first, so that most are never looked at:
1. documents of equal sets become one class (partial aggregation), and only a class's first document goes on;
2. in each band's bucket, every class is compared with the bucket's least class and with its greatest, not with all others;
   pairs whose signatures are far below the threshold are left out; of the rest, each class's best pair is confirmed on full
   sets, then the next ones, as long as they would join different components;
3. only buckets whose classes then lie in different components are looked at again: their classes are parted by the sizes of
   their sets (similar sets lie in the same or neighbouring parts) and by hash into blocks of bounded size, where signatures
   are compared in memory and only similar pairs over two components come out; these are confirmed as before.
No bucket, partner or candidate is dropped, whatever its size.

In near_duplicates(), whose result is by doc_id, rows that share a doc_id count as one document; dedup() judges each row by
its own text. Null text has an empty set. A row without a key whose set a row with a key has is a copy of that row's; other rows
without a key have no component and stay. Result columns replace columns of those names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship, size_bounded, sweep
from .components import components
from .spans import chunks, lower_ascii, mix, span_hashes, word_spans

BANDS, ROWS = 40, 5
#: Classes of a bucket that are compared in memory at a time.
BLOCK = 512
#: Document ids up to which the documents to be confirmed are picked by a broadcast of their ids (8 bytes each), else by a join.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)
_ODD = _rng.integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column, words: int):
    """For each chunk of an Arrow string column: (hashes of the rows' distinct shingles, row after row; where each row's begin, with the end)."""
    for _, _, data, off in chunks(column):
        data = lower_ascii(data)
        starts, ends, cut = word_spans(data, off)
        h = span_hashes(data, starts, ends)
        n = np.diff(cut)
        sets, size = [], np.zeros(len(n), np.int64)
        if len(h) >= words:
            s = np.zeros(len(h) - words + 1, np.uint64)
            for k in range(words):
                s += h[k : len(h) - words + 1 + k] * _ODD[k]
            s = mix(s)
        for i, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if z - a >= words:
                own = np.unique(s[a : z - words + 1])
            elif z > a:
                own = mix(np.array([np.sum(h[a:z] * _ODD[: z - a]) + np.uint64(z - a)], np.uint64))
            else:
                continue
            sets.append(own)
            size[i] = len(own)
        yield np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(size)])


def signatures(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Rows of BANDS * ROWS minima, for the sets that aren't empty."""
    begin = cut[:-1][np.diff(cut) > 0]
    out = np.empty((len(begin), len(_A)), np.uint32)
    if len(begin):
        x = (values >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for k in range(len(_A)):
            np.multiply(x, _A[k], out=y)
            np.add(y, _B[k], out=y)
            out[:, k] = np.minimum.reduceat(y, begin)
    return out


def sketches(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, digest: of the set, sig: a byte of each minimum, bands: a hash of each band)."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = 0
            for values, cut in shingle_sets(b.column(1), words):
                n = np.diff(cut)
                full = n > 0
                sig = signatures(values, cut)
                rows = len(n)
                digest = np.zeros((rows, 2), np.uint64)
                if full.any():
                    begin = cut[:-1][full]
                    digest[full, 0] = np.add.reduceat(values * _ODD[40], begin)
                    digest[full, 1] = np.add.reduceat(mix(values ^ _ODD[41]), begin)
                band = np.zeros((len(sig), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * _ODD[50] + sig.reshape(len(sig), BANDS, ROWS)[:, :, r].astype(np.uint64))
                band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[51])
                small = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                width = np.where(full, 1, 0)
                offsets = np.concatenate([[0], np.cumsum(width)])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, rows),
                        pa.array(n.astype(np.int64)),
                        pa.array([x.tobytes() for x in digest], pa.binary()),
                        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((offsets * small.shape[1]).astype(np.int32)), pa.py_buffer(small.tobytes())]),
                        pa.ListArray.from_arrays(pa.array((offsets * BANDS).astype(np.int32)), pa.array(band.view(np.int64).ravel())),
                    ],
                    names=[key, "n_shingles", "digest", "sig", "bands"],
                )
                at += rows

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` bigint, n_shingles bigint, digest binary, sig binary, bands array<bigint>")


def full_sets(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shingles: the sorted hashes of the set as bytes)."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = 0
            for values, cut in shingle_sets(b.column(1), words):
                rows = len(cut) - 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, rows), pa.array([values[a:z].tobytes() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.large_binary() if values.nbytes > 1 << 30 else pa.binary())], names=[key, "shingles"])
                at += rows

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` bigint, shingles binary")


def _least_agreement(threshold: float) -> float:
    """So many equal signature bytes a pair at the threshold has, but for three cases in a million."""
    k = BANDS * ROWS
    chance = threshold + (1 - threshold) / 256
    return k * chance - 4.5 * (k * chance * (1 - chance)) ** 0.5


def _similar_signatures(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """(a, b, met: equal signature bytes) of the pairs whose signatures and sizes allow the threshold."""
    import pyarrow as pa

    k, least = BANDS * ROWS, _least_agreement(threshold)

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in (2, 3))
            met = (x == y).sum(1)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(met.astype(np.int32))], names=["a", "b", "met"]).filter(pa.array(met >= least))

    side = lambda c: sketch.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint, met int")


def _across(mixed: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """mixed: (bucket, rep, component). The similar pairs (a, b, met) over two components of a bucket. Large buckets are cut into blocks, and every two blocks meet in a group of bounded size."""
    import pyarrow as pa

    k, least = BANDS * ROWS, _least_agreement(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("met", pa.int32())])

    def run(t):
        rep, comp, first, second, size = (t.column(c).to_numpy() for c in ("rep", "component", "first", "second", "n_shingles"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, k)
        out: list[list[np.ndarray]] = [[], [], []]
        left, right = np.flatnonzero(first), np.flatnonzero(second)
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & (np.minimum(size[right], size[x]) >= threshold * np.maximum(size[right], size[x]) - 1e-9)]
            if second[x]:  # a block with itself
                y = y[y > x]
            met = (sig[y] == sig[x]).sum(1)
            y, met = y[met >= least], met[met >= least]
            out[0].append(np.minimum(rep[y], rep[x]))
            out[1].append(np.maximum(rep[y], rep[x]))
            out[2].append(met)
        none = np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(np.concatenate([none, *out[0]]), pa.int64()), pa.array(np.concatenate([none, *out[1]]), pa.int64()), pa.array(np.concatenate([none, *out[2]]).astype(np.int32))], schema=schema)

    # Two sets at the threshold differ in size by a factor of 1 / threshold at most: their parts are the same or neighbours.
    part = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-np.log(threshold) + 1e-9).cast("double")).cast("int")
    sized = mixed.join(sketch.select("rep", "n_shingles", "sig"), "rep").withColumn("part", part)
    counts = sized.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    near = counts.select("bucket", (F.col("part") - 1).alias("part"), F.col("n").alias("n_above")), counts.select("bucket", (F.col("part") + 1).alias("part"), F.col("n").alias("n_below"))
    around = materialize(counts.join(near[0], ["bucket", "part"], "left").join(near[1], ["bucket", "part"], "left").where((F.col("c0") < F.col("c1")) | F.col("n_above").isNotNull() | F.col("n_below").isNotNull()).select("bucket", "part", "n", F.coalesce("n_above", F.lit(0)).alias("n_above"), F.coalesce("n_below", F.lit(0)).alias("n_below")), "parts")
    cut = sized.join(around, ["bucket", "part"]).withColumn("block", F.pmod(F.xxhash64("rep"), blocks("n")).cast("int"))
    name = lambda p, b: F.struct(p.alias("p"), b.alias("b"))
    all_ = lambda p, n: F.transform(F.when(blocks(n) > 0, F.sequence(F.lit(0), blocks(n) - 1)).otherwise(F.expr("CAST(array() AS array<int>)")), lambda o: name(F.col("part") + p, o))
    spread = cut.withColumn("own", name(F.col("part"), F.col("block"))).withColumn("o", F.explode(F.concat(all_(0, "n"), all_(1, "n_above"), all_(-1, "n_below"))))
    spread = spread.select("bucket", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") == F.greatest("own", "o")).cast("int").alias("second"), (F.col("own") == F.least("own", "o")).cast("int").alias("first"), "rep", "component", "n_shingles", "sig")
    return spread.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint, met int")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) that are similar on full sets: 100 * |A and B| >= percent * |A or B|."""
    import pyarrow as pa

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = materialize(pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct(), "ids")
    own = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text)).join(F.broadcast(ids) if size_bounded(ids, BROADCAST_IDS) else ids, key, "left_semi")
    sets = materialize(full_sets(own, words, key, text), "shingle-sets")
    side = lambda c: sets.select(F.col(key).alias(c), F.col("shingles").alias(f"s_{c}"))
    found = materialize(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint").distinct(), "links")
    discard(sets)
    sweep(docs.sparkSession)
    return found


def _linked(candidates: DataFrame, links: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Confirm candidates (a, b, met), best first, until none joins two components. The links (u, v) so far, and their components."""
    label = materialize(components(links), "labels")
    rest = candidates
    for most in (1, 4, None):
        part = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        rest = materialize(rest.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "met"), "open")
        if not rest.limit(1).count():
            break
        if most is None:
            chosen = rest
        elif most == 1:
            best = rest.groupBy("b").agg(F.max(F.struct("met", "a")).alias("m"))
            chosen = best.select("m.a", "b")
        else:
            span = rest.groupBy("b").agg(F.array_sort(F.collect_set("met")).alias("all"))  # at most as many values as minima
            chosen = rest.join(span.select("b", F.element_at("all", F.greatest(F.size("all") - most + 1, F.lit(1))).alias("from")), "b").where(F.col("met") >= F.col("from")).select("a", "b")
        chosen = materialize(chosen, "chosen")
        found = _confirmed(chosen, docs, words, percent, key, text)
        rest = rest.join(chosen, ["a", "b"], "left_anti")
        links = materialize(links.unionByName(found.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links")
        label = materialize(components(links), "labels")
    return links, label


def _stars(buckets: DataFrame) -> DataFrame:
    """buckets: (bucket, rep). Pairs (a < b) of each class with its bucket's least and greatest class. Both are found by partial aggregation; the join back splits hot buckets."""
    ends = buckets.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    linked = buckets.join(ends, "bucket")
    return linked.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("rep").alias("b")), F.struct(F.col("rep").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.*").where("a < b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id: least key reachable over links, kept: whether the row is that one), a row for each row of docs."""
    sketch = materialize(sketches(docs, words, key, text), "sketches")
    classes = sketch.where("n_shingles > 0").groupBy("digest").agg(F.min(key).alias("rep"))
    member = materialize(sketch.select(key, "n_shingles", "digest").join(classes, "digest", "left").select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"), "digest"), "members")
    firsts = member.where(F.col(key) == F.col("rep")).select("rep", "digest").distinct()
    reps = materialize(sketch.join(firsts, (F.col(key) == F.col("rep")) & (sketch["digest"] == firsts["digest"]), "left_semi").select(F.col(key).alias("rep"), "n_shingles", "sig", "bands").dropDuplicates(["rep", "n_shingles", "sig"]), "classes")
    # Rows that share a key tie their classes together.
    same = member.where("rep is not null").groupBy(key).agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("v < u").select("u", "v")
    links = materialize(same, "links")
    discard(sketch)
    # Buckets of one class link nothing: only those of several are kept.
    exploded = reps.select("rep", F.explode("bands").alias("bucket"))
    several = exploded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket")
    buckets = materialize(exploded.join(several, "bucket", "left_semi"), "buckets")
    sweep(docs.sparkSession)
    candidates = materialize(_similar_signatures(_stars(buckets), reps, percent / 100).distinct(), "candidates")
    links, label = _linked(candidates, links, docs, words, percent, key, text)
    labelled = buckets.join(label, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("bucket")
    mixed = materialize(labelled.join(open_, "bucket").select("bucket", "rep", "component"), "mixed")
    discard(buckets)
    across = _across(mixed, reps, percent / 100).distinct().join(candidates.select("a", "b"), ["a", "b"], "left_anti")
    across = materialize(across, "across")
    for done in (mixed, reps, candidates):
        discard(done)
    if across.limit(1).count():
        links, label = _linked(across, links, docs, words, percent, key, text)
    out = member.join(label, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", key)
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(key), component.isNull()).alias("kept"))


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component, the row of the least key (of several such rows, the one of the least hash of its text). Rows without words are linked with nothing: one of each key stays. Rows that share a key are linked by their texts alone. Rows without a key stay and link nothing."""
    number = F.col(key).cast("bigint")
    if not docs.where(number.isNotNull()).groupBy(number.alias("_key")).count().where("count > 1").limit(1).count():
        found = materialize(near_duplicates(docs, words, percent, key, text), "near")
        dropped = found.where("not kept").select(F.col(key).alias("_dropped"))
        return docs.join(dropped, number == F.col("_dropped"), "left_anti")
    # A key doesn't tell the rows apart: a row's place, written with it, does.
    rows = materialize(docs.where(number.isNotNull()).withColumn("_place", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, words, percent, "_place", text).select("_place", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_group"))
    told = rows.select("_place", number.alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_hash")).join(found, "_place")
    first = told.groupBy("_group", F.when(F.col("_group").isNull(), F.col("_key")).alias("_alone")).agg(F.min(F.struct("_key", "_hash", "_place")).alias("_first"))
    kept = materialize(first.select("_first._place"), "kept")
    return rows.join(kept, "_place", "left_semi").select(*docs.columns).unionByName(docs.where(number.isNull()))
