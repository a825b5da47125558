"""Benchmark decontamination by a distributed positional inverted index; DataFrame operations only.

The index holds the postings (term, row, position) of every word of the corpus; it is a written table that further lookups, also
with other test sets, reuse. A window of `WINDOW` consecutive item words (an item of fewer is
one window) is found from its rarest terms: the postings of the `RAREST` rarest, shifted by their offsets, meet in candidate
alignments (row, item, diagonal); all words of the surviving alignments are then intersected with the index, and runs of
`WINDOW` aligned positions are the exact matches. Counts of terms are taken over the whole index. A term stands in the index as
its 64-bit hash; a false match would take a collision at every word of a window that differs.

Rows are told apart by their place in the input, so repeated doc_ids, also with different texts, are each judged on their
own. Null and empty texts have no words and aren't contaminated; items without words match nothing. An empty test set or
corpus gives no hits or no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, size_bounded

WINDOW, RAREST = 13, 3
#: Rows up to which a side is broadcast, of some 16 to 60 bytes each; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    c = F.coalesce(text.cast("string"), F.lit(""))
    # lower() touches more than A-Z only where there are other capitals.
    low = F.when(c.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(c, _CAPITALS, _SMALL)).otherwise(F.lower(c))
    w = F.split(low, _BETWEEN, -1)
    lead, trail = (F.element_at(w, k) == "" for k in (1, -1))
    n = F.greatest(F.size(w) - lead.cast("int") - trail.cast("int"), F.lit(0))
    return F.slice(w, lead.cast("int") + 1, n)


def _maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if size_bounded(df, rows) else df


@dataclass
class Index:
    """postings: (tid, row, pos) of all words; rows: (row, the key, n_words)."""

    postings: DataFrame
    rows: DataFrame
    key: str


def term_id(term: Column) -> Column:
    """What stands for a term in the index: its hash, never 0."""
    h = F.xxhash64(term)
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item: the row's place, the key, n: words of the item, ipos, tid)."""
    listed = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_id"), words(F.col(text)).alias("w"))
    return listed.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "term")).select("item", "item_id", "n", "ipos", term_id(F.col("term")).alias("tid"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index every word of the corpus. One pass over the texts, without a shuffle of postings."""
    # After the last word of each row comes an entry (tid 0) with its key: its position is the number of words.
    listed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), F.concat(words(F.col(text)), F.array(F.lit(""))).alias("w"))
    entries = listed.select("row", "_key", F.posexplode("w").alias("pos", "term"))
    tid = F.when(F.col("term") == "", F.lit(0).cast("bigint")).otherwise(term_id(F.col("term")))
    written = materialize(entries.select(tid.alias("tid"), "row", "pos", F.when(F.col("term") == "", F.col("_key")).alias("_key")), "postings")
    rows = written.where("tid = 0").select("row", F.col("_key").alias(key), F.col("pos").cast("bigint").alias("n_words"))
    return Index(written.where("tid <> 0").select("tid", "row", "pos"), rows, key)


def _placed(index: Index, items: DataFrame) -> DataFrame:
    """The items' words with the number of postings of each (df). Only postings of the items' terms leave the scan."""
    terms = materialize(items.select("tid").distinct(), "terms")
    df = index.postings.join(_maybe_broadcast(terms), "tid", "left_semi").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    return materialize(items.join(df, "tid", "left").select("item", "item_id", "n", "ipos", "tid", F.coalesce("df", F.lit(0)).alias("df")), "item-words")


def phrase_matches(index: Index, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """items: as item_words() gives. (row, item, item_id, start, size) of every occurrence of a window; row as in the index."""
    placed = _placed(index, items)
    # Of each window, the places of its rarest terms; windows with a term that the corpus lacks can't occur.
    per_item = placed.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("ipos", "df", "tid"))).alias("w"))
    size = F.least("n", F.lit(window))
    sliced = F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda s: F.array_sort(F.transform(F.slice("w", s, size), lambda x: F.struct(x["df"].alias("df"), x["ipos"].alias("ipos"), x["tid"].alias("tid")))))
    possible = F.filter(sliced, lambda x: x[0]["df"] > 0)
    chosen = F.array_distinct(F.flatten(F.transform(possible, lambda x: F.slice(x, 1, rarest))))
    places = materialize(per_item.select("item", F.least(size, F.lit(rarest)).alias("need"), F.explode(chosen).alias("x")).select("item", "need", "x.ipos", "x.tid"), "rarest")
    aligned = index.postings.join(_maybe_broadcast(places), "tid").groupBy("row", "item", (F.col("pos") - F.col("ipos")).alias("diagonal"))
    alignments = materialize(aligned.agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need")).where("met >= need").select("row", "item", "diagonal"), "alignments")
    # All words of these alignments.
    rows = alignments.select("row").distinct()
    near = index.postings.join(_maybe_broadcast(rows), "row", "left_semi")
    wanted = alignments.join(placed.select("item", "ipos", "tid"), "item").select("row", "item", "diagonal", "ipos", "tid", (F.col("diagonal") + F.col("ipos")).alias("pos"))
    met = near.join(wanted, ["row", "pos", "tid"]).groupBy("row", "item", "diagonal").agg(F.array_sort(F.collect_list("ipos")).alias("p"))
    sizes = placed.groupBy("item").agg(F.first("item_id").alias("item_id"), F.least(F.first("n"), F.lit(window)).alias("size"))
    runs = met.join(sizes, "item").where("size(p) >= size")
    first = F.filter(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("size")), lambda i: F.when(F.get("p", i + F.col("size") - 1) - F.get("p", i) == F.col("size") - 1, F.get("p", i))), lambda x: x.isNotNull())
    return runs.select("row", "item", "item_id", "size", "diagonal", F.explode(first).alias("s")).select("row", "item", "item_id", (F.col("diagonal") + F.col("s")).alias("start"), "size")


def proximity_matches(index: Index, items: DataFrame, slop: int) -> DataFrame:
    """(row, item, item_id, pos): places of an item's rarest term around which every other word of the item occurs within slop of its own offset, in any order."""
    placed = _placed(index, items)
    anchor = placed.groupBy("item").agg(F.min(F.struct("df", "ipos", "tid")).alias("a")).select("item", F.col("a.ipos").alias("apos"), F.col("a.tid").alias("tid"))
    at = index.postings.join(_maybe_broadcast(anchor), "tid").select("row", "item", "apos", F.col("pos").alias("at"))
    wanted = at.join(placed, "item").select("row", "item", "item_id", "n", "at", "ipos", "tid", (F.col("at") + F.col("ipos") - F.col("apos")).alias("want"))
    met = wanted.join(index.postings, ["row", "tid"]).where(F.abs(F.col("pos") - F.col("want")) <= slop)
    return met.groupBy("row", "item", "item_id", "n", "at").agg(F.count_distinct("ipos").alias("k")).where("k = n").select("row", "item", "item_id", F.col("at").alias("pos"))


def _matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str) -> tuple[Index, DataFrame]:
    items = materialize(item_words(benchmark, item_key, item_text), "items")
    index = build_index(docs, key, text)
    return index, materialize(phrase_matches(index, items), "matches")


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    index, hits = _matches(docs, benchmark, key, text, item_key, item_text)
    covered = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("row", F.col("item_id").cast("string").alias("i")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("names"))
    out = index.rows.join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(key, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose texts hold no window of a benchmark item, whole. Rows are judged by their texts alone, whatever their keys; null and empty texts stay."""
    told = F.sha2(F.col(text).cast("string").cast("binary"), 256)
    index, hits = _matches(docs.select(told.alias("_told"), F.col(text).alias("_text")), benchmark, "_told", "_text", item_key, item_text)
    rows = hits.select("row").distinct()
    bad = materialize(index.rows.join(_maybe_broadcast(rows), "row", "left_semi").select("_told").distinct(), "contaminated")
    bad = _maybe_broadcast(bad)
    return docs.join(bad, told == bad["_told"], "left_anti")
