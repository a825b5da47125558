"""Relevance: BM25 in its several forms, search with context, corpus term statistics, coverage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def exploded_tokens(docs: DataFrame, key: str, text: str, longer_than: int = 2) -> DataFrame:
    return docs.select(key, F.explode(T.tokens(F.col(text), longer_than)).alias("term"))


def term_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, tf, df). A document's words are sorted in the row, so that each term's first place counts the document and one shuffle, after partial aggregation, is enough. The key isn't needed."""
    words = docs.select(F.array_sort(T.tokens(F.col(text))).alias("w"))
    marked = words.select(F.explode(F.zip_with("w", F.concat(F.array(F.lit(None).cast("string")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))), lambda x, before: F.struct(x.alias("term"), (before.isNull() | (x != before)).cast("int").alias("first")))).alias("x"))
    return marked.where("x.term is not null").groupBy(F.col("x.term").alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.sum("x.first").alias("df"))


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, form: str = "okapi") -> DataFrame:
    """(key, score) of documents that hold a query term. Terms of the query count as often as they come.

    form okapi: idf ln(N - n + .5) - ln(n + .5), a negative one becoming a quarter of the terms' mean; form plus: ln(1 + (N - n + .5) / (n + .5)).
    The query's terms are few; all else is partial aggregation.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(t, query.count(t)) for t in dict.fromkeys(query)], "term string, times int")
    sized = docs.select(key, T.tokens(F.col(text), 0).alias("w")).select(key, F.size("w").alias("len"), "w")
    total = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avgdl"))
    hits = sized.select(key, "len", F.explode("w").alias("term")).join(F.broadcast(wanted), "term").groupBy(key, "len", "term", "times").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    stats = df.crossJoin(F.broadcast(total))  # one row on that side
    if form == "okapi":
        raw = F.log(F.col("n_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
        stats = stats.withColumn("raw", raw).withColumn("idf", F.when(F.col("raw") < 0, 0.25 * F.avg("raw").over(W.partitionBy())).otherwise(F.col("raw")))
    else:
        stats = stats.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    scored = hits.join(F.broadcast(stats), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return scored.groupBy(key).agg(F.sum(part).alias("score"))


def head_bm25(tokens: Column, query: list[str], average: float = 1e3, b: float = 0.75, k1: float = 1.2) -> Column:
    """The form for head sections, in one expression: its idf depends on the term's own frequency."""
    n = F.size(tokens)
    out = F.lit(0.0)
    for t in dict.fromkeys(query):
        tf = F.size(F.filter(tokens, _equal(t))).cast("double")
        out = out + F.log(F.lit(2.0) / (tf + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / average))
    return out


def _equal(t: str):
    return lambda x: x == t


def min_max(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Scores brought to 0..1 within a result; all equal: 0.5."""
    bounds = scores.groupBy(*by).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    joined = scores.join(bounds, list(by)) if by else scores.crossJoin(F.broadcast(bounds))  # one row on that side
    return joined.withColumn("score", F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def above_ratio(scores: DataFrame, ratio: float = 0.5) -> DataFrame:
    """The rows of a result that score ratio of the best at least."""
    top = scores.agg(F.max("score").alias("_top"))
    return scores.crossJoin(F.broadcast(top)).where(F.col("score") >= ratio * F.col("_top")).drop("_top")


def above_mean(scores: DataFrame, sigmas: float = 0.25) -> DataFrame:
    """The rows that score over the mean by more than so many population deviations."""
    bar = scores.agg((F.avg("score") + sigmas * F.stddev_pop("score")).alias("_bar"))
    return scores.crossJoin(F.broadcast(bar)).where("score > _bar").drop("_bar")


def rank_files(scores: DataFrame, facts: DataFrame, query: list[str], key: str = "fact_id", file: str = "file", text: str = "fact", top: int = 5) -> DataFrame:
    """(file, total, matches, code, weight) of the best files: scores (key, score) of facts joined to their files. A fact of three parts between bars names code in the third: the share of query terms there counts twice, each match one and a half times."""
    parts = F.split(F.col(text), r"\|")
    q = F.array(*map(F.lit, query))
    code = F.when(F.size(parts) == 3, F.size(F.array_intersect(F.array_distinct(q), T.tokens(F.get(parts, 2), 0))) / len(query)).otherwise(0.0)
    joined = scores.join(facts.select(key, file, code.alias("_code")), key)
    own = joined.groupBy(file).agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("matches"), F.max("_code").alias("code"))
    return own.withColumn("weight", 2 * F.col("code") + 1.5 * F.col("matches") + F.col("total")).orderBy(F.desc("weight"), file).limit(top)


def with_neighbours(chunks: DataFrame, hit: Column, by: str, pos: str) -> DataFrame:
    """The chunks that are hits, and those next to them."""
    w = W.partitionBy(by).orderBy(pos).rowsBetween(-1, 1)
    return chunks.withColumn("_near", F.max(hit.cast("int")).over(w)).where("_near = 1").drop("_near")


def rank_weighted(scores: Column) -> Column:
    """Mean of scores weighted by 1 / rank."""
    s = F.reverse(F.array_sort(scores))
    top = F.aggregate(F.transform(s, lambda x, i: x / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return top / F.aggregate(F.transform(s, lambda x, i: F.lit(1.0) / (i + 1)), F.lit(0.0), lambda a, x: a + x)


def coverage(stats: DataFrame, query: list[str], n_docs: DataFrame) -> DataFrame:
    """One row (coverage): how well a collection covers the query's terms. n_docs: one row (n)."""
    wanted = stats.sparkSession.createDataFrame([(t,) for t in query], "term string")
    top = stats.agg(F.max("tf").alias("max_tf"))
    joined = F.broadcast(wanted).join(stats, "term", "right").where(F.col("term").isin(*query))
    each = wanted.join(F.broadcast(joined.groupBy("term").agg(F.first("tf").alias("tf"), F.first("df").alias("df"))), "term", "left").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(n_docs))
    score = F.coalesce(F.col("df") / F.col("n") * (1 + 0.5 * F.log1p("tf") / F.log1p("max_tf")), F.lit(0.0))
    return each.agg(F.least(F.lit(1.0), F.sqrt(F.avg(score))).alias("coverage"))


#: Documents that are compared with as many others in one group.
BLOCK = 256


def consistency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (consistency): the mean Jaccard similarity of all pairs of documents; 1 for fewer than two.

    Meant for the pages of one crawl, as the pairs grow by the square. Documents are dealt to blocks by hash and every two blocks
    meet in a group of bounded size, from which only a sum comes out; a word that all documents share makes no group of its own.
    """
    import pyarrow as pa

    n = docs.count()
    k = max(1, -(-n // BLOCK))

    def run(t):
        rows = [np.unique(np.array(x, np.int64)) for x in t.column("w").to_pylist()]
        own = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]))
        m = np.zeros((len(rows), len(own)), np.float32)
        for i, r in enumerate(rows):
            m[i, np.searchsorted(own, r)] = 1
        first, second = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
        size = m.sum(1)
        both = m[first] @ m[second].T
        all_ = size[first][:, None] + size[second][None, :] - both
        j = np.divide(both, all_, out=np.zeros_like(both, np.float64), where=all_ > 0)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        return pa.table({"s": [float((j.sum() - np.trace(j)) / 2 if same else j.sum())]})

    dealt = docs.select(F.pmod(F.xxhash64(key), F.lit(k)).alias("b"), F.transform(F.array_distinct(T.tokens(F.col(text))), lambda w: F.xxhash64(w)).alias("w"))
    spread = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    groups = spread.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") == F.least("b", "o")).alias("first"), (F.col("b") == F.greatest("b", "o")).alias("second"), "w")
    total = groups.groupBy("i", "j").applyInArrow(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    pairs = n * (n - 1) / 2
    return total.select((F.lit(1.0) if pairs < 1 else F.col("s") / pairs).alias("consistency"))


def new_terms(steps: DataFrame, step: str = "step") -> DataFrame:
    """(step, new_terms) of (step, term) rows: terms that no earlier step had."""
    first = steps.groupBy("term").agg(F.min(step).alias(step))
    counted = first.groupBy(step).agg(F.count(F.lit(1)).alias("n"))
    return steps.select(step).distinct().join(counted, step, "left").select(step, F.coalesce("n", F.lit(0)).alias("new_terms"))


def saturation(history: DataFrame, step: str = "step") -> DataFrame:
    """One row (saturation): 1 less the last step's new terms against the first's, 0 to 1."""
    return history.agg(F.min_by("new_terms", step).alias("a"), F.max_by("new_terms", step).alias("z")).select(F.when(F.col("a") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("z") / F.col("a")))).alias("saturation"))


def confidence(coverage_: Column, consistency_: Column, saturation_: Column) -> Column:
    return 0.4 * coverage_ + 0.3 * consistency_ + 0.3 * saturation_


def link_rank(relevance: Column, novelty: Column, authority: Column | None = None) -> Column:
    return 0.5 * relevance + 0.3 * novelty + 0.2 * (F.lit(1.0) if authority is None else authority)


_TAG_SAY = {"h1": 5.0, "h2": 4.0, "h3": 3.0, "title": 4.0, "strong": 2.0, "b": 1.5, "em": 1.5, "blockquote": 2.0, "code": 2.0, "pre": 1.5, "th": 1.5}


def relevant_blocks(blocks: DataFrame, query: list[str], by: str = "page_id", pos: str = "pos", tag: str = "tag", text: str = "text", least: float = 1.0, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The blocks of each page that score least or more against a query, with their scores: Okapi BM25 over the page's own blocks, times the weight of the block's tag. A term in more than half of them counts a quarter of the page's mean idf."""
    q = list(dict.fromkeys(query))
    sized = blocks.withColumn("_w", T.tokens(F.col(text), 0)).withColumn("_n", F.size("_w"))
    whole = sized.groupBy(by).agg(F.count(F.lit(1)).alias("_blocks"), F.avg("_n").alias("_mean"))
    df = sized.select(by, F.explode(F.array_distinct("_w")).alias("_t")).groupBy(by, "_t").agg(F.count(F.lit(1)).alias("_df"))
    raw = F.log(F.col("_blocks") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5)
    terms = df.join(whole.select(by, "_blocks"), by).withColumn("_idf", raw)
    stats = terms.groupBy(by).agg(F.avg("_idf").alias("_avg"), F.map_from_entries(F.collect_list(F.when(F.col("_t").isin(*q), F.struct("_t", "_idf")))).alias("_idfs"))
    joined = sized.join(whole, by).join(stats, by)
    score = F.lit(0.0)
    for x in query:
        tf = F.size(F.filter("_w", _equal(x))).cast("double")
        idf = F.coalesce(F.try_element_at("_idfs", F.lit(x)), F.lit(0.0))
        idf = F.when(idf < 0, 0.25 * F.col("_avg")).otherwise(idf)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    weight = F.lit(1.0)
    for name, say in _TAG_SAY.items():
        weight = F.when(F.col(tag) == name, say).otherwise(weight)
    return joined.withColumn("score", score * weight).where(F.col("score") >= least).select(*blocks.columns, "score")


def content_of(mode: Column, raw: Column, cleaned: Column, fit: Column, markdown: Column, fit_markdown: Column) -> Column:
    """The form of a page that a consumer asks for by name; where the pruned forms are empty, the whole ones; an unknown name gives markdown."""
    some = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    return F.when(mode == "raw_html", raw).when(mode == "cleaned_html", cleaned).when(mode == "fit_html", some(fit, cleaned)).when(mode == "fit_markdown", some(fit_markdown, markdown)).otherwise(markdown)
