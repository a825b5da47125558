"""Sources of pages and urls, and the page cache."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of stored pages, one a file."""
    return spark.read.format("binaryFile").load(path).select(F.concat(F.lit("file://"), F.regexp_replace("path", "^file:/*", "/")).alias("url"), F.decode("content", "UTF-8").alias("html"))


def raw_pages(spark: SparkSession, pages: list[tuple[str, str]]) -> DataFrame:
    """(url, html) of literal pages."""
    return spark.createDataFrame(pages, "url string, html string")


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """(map, pos, loc, is_index) of (url, xml) rows; any or no namespace prefix; relative locations are resolved."""
    from ..functions.urls import resolve

    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:[\w-]+:)?loc\s*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:[\w-]+:)?loc>"), F.lit(1))
    is_index = F.col("xml").rlike(r"(?i)<(?:[\w-]+:)?sitemapindex\b")
    rows = maps.select(F.col("url").alias("map"), is_index.alias("is_index"), F.posexplode(locs).alias("pos", "l"))
    return rows.select("map", "pos", resolve(F.col("map"), F.replace(F.col("l"), F.lit("&amp;"), F.lit("&"))).alias("loc"), "is_index")


def sitemap_leaves(maps: DataFrame, root: str, most_depth: int = 5) -> DataFrame:
    """All page urls under a root map; indexes lead to further maps of the same table."""
    entries = sitemap_urls(maps)
    front = maps.where(F.col("url") == root).select(F.col("url").alias("map"))
    out = None
    for _ in range(most_depth):
        here = entries.join(front, "map", "left_semi")
        pages = here.where(~F.col("is_index")).select("loc")
        out = pages if out is None else out.unionByName(pages)
        front = here.where("is_index").select(F.col("loc").alias("map")).distinct()
        if front.isEmpty():
            break
    return out.distinct()


def assemble(files: DataFrame, sections: list[str] = (), condensed: bool = False, name: str = "name", text: str = "text") -> DataFrame:
    """(name, content, number) of documentation files in the order of the numbers that their names begin with (names without one last, then by name): files named `base.md`, `base.xs.md` (condensed) and `base.q.md` (left out), those whose base holds one of the sections, in any case. Condensed: the condensed file where there is one. content begins with a banner."""
    base = F.get(F.split(F.col(name), r"\."), 0)
    own = files.where(~F.col(name).endswith(".q.md") & F.col(name).rlike("^[0-9].*\\.md$")).withColumn("_base", base).withColumn("_short", F.col(name).endswith(".xs.md"))
    if sections:
        own = own.where(F.exists(F.array(*map(F.lit, sections)), lambda s: F.contains(F.lower("_base"), F.lower(s))))
    rank = F.when(F.col("_short"), 1 if condensed else -1).otherwise(0)
    first = F.regexp_extract(F.col(name), "^([0-9]+)(?:_|$|[.])", 1)
    best = own.where(rank >= 0).groupBy("_base").agg(F.max(F.struct(rank.alias("r"), F.col(name).alias("name"), F.col(text).alias("text"), F.coalesce(F.nullif(first, F.lit("")).cast("long"), F.lit(999999)).alias("n"))).alias("m"))
    bar = F.repeat(F.lit("#"), 20)
    rows = best.select(F.struct("m.n", "_base").alias("_order"), F.col("m.name").alias("name"), F.concat(bar, F.lit("\n# "), F.col("m.name"), F.lit("\n"), bar, F.lit("\n\n"), F.col("m.text")).alias("content"))
    return rows.orderBy("_order").select("name", "content", F.col("_order.n").alias("number"))


def crawl_index(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(url, status) of an index of JSON lines."""
    from ..functions.urls import seed_glob

    return spark.read.schema("url string, status string").json(path).where(seed_glob(F.col("url"), pattern)).dropDuplicates(["url"])


def robots_sitemaps(robots: Column) -> Column:
    return F.transform(F.regexp_extract_all(robots, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1)), lambda x: x)


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (domain, url, ...) with allowed, against rules (domain, robots_txt): the first rule of the agent's group whose path the url's path begins with decides. Without rules a url is allowed.

    The texts are parsed once a domain; a url meets its domain's rules as columns.
    """
    import pyarrow as pa

    kind = "array<struct<path:string,allow:boolean>>"

    @F.arrow_udf(kind)
    def parsed(texts):
        out = []
        for t in texts.to_pylist():
            r = RobotFileParser()
            r.parse((t or "").splitlines())
            group = next((e for e in r.entries if e.applies_to(agent)), r.default_entry)
            out.append([{"path": x.path, "allow": bool(x.allowance)} for x in group.rulelines] if group else [])
        return pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("allow", pa.bool_())])))

    own = rules.select("domain", parsed("robots_txt").alias("_rules"))
    target = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    met = F.filter("_rules", lambda r: (r["path"] == "*") | target.startswith(r["path"]))
    return urls.join(own, "domain", "left").withColumn("allowed", F.coalesce(F.get(met, F.lit(0))["allow"], F.lit(True))).drop("_rules")


def partial_head(html: Column) -> Column:
    """A page up to the end of its head, whatever the case of the tag; the whole page without one."""
    return F.get(F.split(html, r"(?i)</head\s*>", 2), 0)


def union_seeds(*sources: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """(url, source, pos) of several sources of (url, pos): each url where it comes first, by the order of the sources, then of the rows."""
    rows = [s.select(url, F.lit(k).alias("source"), F.col(pos).cast("bigint").alias(pos)) for k, s in enumerate(sources)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy(url).agg(F.min(F.struct("source", pos)).alias("m")).select(url, "m.source", f"m.{pos}")


def seed_domains(urls: DataFrame, domain: str = "domain", score: str = "score", most: int = 100, url: str = "url") -> DataFrame:
    """The best urls of each domain by score, then by name, with their rank. A domain's list is cut in the window, whose sort spills."""
    w = W.partitionBy(domain).orderBy(F.desc(score), url)
    return urls.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


class PageCache:
    """Pages by url in a table: upsert, probe, count, clear. Files are bucketed by a hash of the url, and an upsert rewrites only the buckets that it meets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def table(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def upsert(self, rows: DataFrame) -> None:
        """rows: (url, ts, ...). Of rows with a url, the latest stays."""
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}.stage/_SUCCESS")
        if done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            self._publish()
        new = rows.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int"))
        old = self.table()
        if old is not None:
            met = new.select("bucket").distinct()
            new = old.join(F.broadcast(met), "bucket", "left_semi").unionByName(new)  # as many rows as buckets at most
        merged = latest(new, "url", "ts")
        stage = f"{self.path}.stage"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(stage)
        self._publish()

    def _publish(self) -> None:
        """Bring the finished stage's buckets into the table and remove it. A failure leaves the whole stage, from which the next call begins."""
        stage = f"{self.path}.stage"
        self.spark.read.parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(stage)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def probe(self, urls: DataFrame) -> DataFrame:
        """urls ⟕ cache."""
        own = self.table()
        return urls if own is None else urls.join(own.drop("bucket"), "url", "left")

    def missing(self, urls: DataFrame) -> DataFrame:
        own = self.table()
        return urls if own is None else urls.join(own.select("url"), "url", "left_anti")

    def count(self) -> int:
        own = self.table()
        return 0 if own is None else own.count()

    def clear(self) -> None:
        own = self.table()
        if own is not None:
            own.limit(0).write.mode("overwrite").parquet(self.path)


def latest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Of rows with a key, the one of the latest time."""
    w = W.partitionBy(key).orderBy(F.desc(ts))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def within_ttl(ts: Column, now: Column, days: int = 7) -> Column:
    return ts > now - F.expr(f"INTERVAL {int(days)} DAYS")


def cache_decision(mode: Column, url: Column) -> Column:
    """struct<read,write> by cache mode, for urls that can be cached."""
    can = url.rlike("^(?:https?|file)://")
    return F.struct((can & mode.isin("enabled", "read_only")).alias("read"), (can & mode.isin("enabled", "write_only")).alias("write"))
