"""Exact deduplication by a persistent digest index, bucketed and sorted by hash.

A text's digest is the SHA-256 of its UTF-8 bytes after each run of `[\\x20\\x09-\\x0D]` has become one space; null counts as
empty. The index is a bucketed table (digest, keep_id, group_size): it joins new data by sort-merge without being shuffled
itself, and new digests are appended to it. Equal texts in one batch are reduced by partial aggregation before anything is
shuffled, so a text that a third of all rows share costs one row a task; where rows get their groups back, groups of one row
need no join, and the few largest groups are joined by broadcast. Rows of equal text and key are all counted.

Rows without a key: they count in group_size; where a row with a key has their text they are copies of it, else all of them stay
and keep_id is null.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "text"):
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


#: Rows of a group from which on it is joined by broadcast: so many, or more where that would be more than MOST_LARGE groups.
LARGE, MOST_LARGE = 10_000, 100_000


def buckets_for(rows: int) -> int:
    """Buckets of an index that begins with so many rows: some two million a bucket."""
    return max(16, min(1 << 16, rows // 2_000_000))


def with_groups(rows: DataFrame, groups: DataFrame, n_rows: int, key: str = "doc_id", hashed: str = "digest") -> DataFrame:
    """rows: (key, digest), n_rows of them. groups: (digest, keep_id, group_size), of which only those of several rows are needed. Adds keep_id and group_size.

    A large group has n_rows / MOST_LARGE rows at least, so there are MOST_LARGE at most: their broadcast is bounded, and no
    group that is left for the join by digest is larger.
    """
    bar = max(LARGE, n_rows // MOST_LARGE)
    several = groups.where("group_size > 1").select(hashed, "keep_id", "group_size")
    large = F.broadcast(several.where(F.col("group_size") >= bar))
    rest = rows.join(large, hashed, "left_anti").join(several.where(F.col("group_size") < bar), hashed, "left")
    out = rows.join(large, hashed).select(key, hashed, "keep_id", "group_size")
    rest = rest.select(key, hashed, F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"))
    return out.unionByName(rest)


class DigestIndex:
    """The index at path. Every call of absorb() is one batch of new data."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the index's name out of the catalog; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, groups: DataFrame) -> None:
        """Add (digest, keep_id, group_size) rows whose digests are new. One file a bucket."""
        ready = groups.select("digest", F.col("keep_id").cast("bigint").alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"))
        ready.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Sort-merge anti-join: the rows whose digest isn't in the index yet."""
        return digests.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def absorb(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Deduplicate new rows against the index and each other, and append what is new. The rows that stay, as (key, digest)."""
        return self.absorb_digests(docs.select(F.col(key).cast("bigint").alias(key), digest(text).alias("digest")), key)

    def absorb_digests(self, rows: DataFrame, key: str = "doc_id") -> DataFrame:
        """absorb() for rows (key, digest)."""
        from .common import materialize

        groups = rows.groupBy("digest").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        fresh = materialize(self.unseen(groups), "fresh-digests")
        self.append(fresh)
        return fresh.select(F.col("keep_id").alias(key), "digest")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row, by an index that begins empty."""
    from .common import materialize, scratch

    rows = materialize(docs.select(F.col(key).cast("bigint").alias(key), digest(text).alias("digest")), "digests")
    n = rows.count()
    index = DigestIndex(docs.sparkSession, scratch(docs.sparkSession, "digest-index"), buckets_for(n))
    index.absorb_digests(rows, key)
    out = with_groups(rows, materialize(index.table().where("group_size > 1"), "groups"), n, key)
    index.forget()
    kept = F.coalesce(F.col(key) == F.col("keep_id"), F.col(key).isNull() & F.col("keep_id").isNull())
    return out.select(key, "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, whole: of equal texts, the row with the smallest key (of rows that are equal in both, one). Rows without a key stay. The rows go through an index that begins empty."""
    from .common import materialize, scratch

    spark = docs.sparkSession
    rows = materialize(docs.select(F.col(key).cast("bigint").alias("_key"), digest(text).alias("digest")).where("_key is not null"), "digests")
    index = DigestIndex(spark, scratch(spark, "digest-index"), buckets_for(rows.count()))
    stay = index.absorb_digests(rows, "_key")
    index.forget()
    number = F.col(key).cast("bigint")
    if rows.groupBy("_key").count().where("count > 1").limit(1).count():  # a key doesn't tell the rows apart
        marked = docs.where(number.isNotNull()).withColumn("_digest", digest(text)).withColumn("_key", number)
        stay = stay.select(F.col("_key").alias("_stays"), F.col("digest").alias("_text_digest"))
        once = marked.join(stay, (F.col("_key") == F.col("_stays")) & (F.col("_digest") == F.col("_text_digest")), "left_semi").dropDuplicates(["_key", "_digest"])
        return once.select(*docs.columns).unionByName(docs.where(number.isNull()))
    stay = stay.select("_key")
    return docs.where(number.isNotNull()).join(stay, number == stay["_key"], "left_semi").unionByName(docs.where(number.isNull()))
