"""Traversal of a link graph: breadth-first, depth-first, best-first, over tables of edges (src, dst)."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that spark.checkpoint.dir names; a session on this machine alone gets a temporary one where that is unset."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, folder, True)
        where = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def unvisited(found: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return found.join(visited.select(key), key, "left_anti").dropDuplicates([key])


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int = 3, max_pages: int | None = None, score: Column | None = None, threshold: float = 0.0) -> DataFrame:
    """(url, parent, depth) level by level. starts: (url). score: an expression over `url`; pages under the threshold are passed by.

    With max_pages, a level that would go beyond is cut after its best (with a score) or first urls by name.
    """
    level = starts.select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")).dropDuplicates(["url"])
    seen = _cut(level)
    for d in range(1, max_depth + 1):
        near = level.select(F.col("url").alias("src")).join(edges, "src").groupBy("dst").agg(F.min("src").alias("parent"))
        nxt = near.select(F.col("dst").alias("url"), "parent", F.lit(d).alias("depth"))
        if score is not None:
            nxt = nxt.withColumn("_s", score).where(F.col("_s") >= threshold)
        nxt = nxt.join(seen.select("url"), "url", "left_anti")
        if max_pages is not None:
            left = max_pages - seen.count()
            nxt = (nxt.orderBy(F.desc("_s"), "url") if score is not None else nxt.orderBy("url")).limit(max(0, left))
        level = _cut(nxt.select("url", "parent", "depth"))
        if level.isEmpty():
            break
        seen = _cut(seen.unionByName(level))
    return seen


def best_first(edges: DataFrame, starts: DataFrame, score: Column, max_pages: int = 100, max_depth: int = 5, batch: int = 10) -> DataFrame:
    """(url, parent, depth, score, batch): in each round the best `batch` pages of the whole frontier by score, depth and url. The frontier stays a table; only its top is ordered."""
    front = _cut(starts.select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")).dropDuplicates(["url"]).withColumn("score", score))
    done, k = None, 0
    while True:
        n = 0 if done is None else done.count()
        top = _cut(front.orderBy(F.desc("score"), "depth", "url").limit(min(batch, max_pages - n)).withColumn("batch", F.lit(k)))
        if n >= max_pages or top.isEmpty():
            break
        done = _cut(top if done is None else done.unionByName(top))
        found = top.where(F.col("depth") < max_depth).join(edges, top["url"] == edges["src"]).groupBy("dst").agg(F.min(F.struct((F.col("depth") + 1).alias("depth"), F.col("src"))).alias("m"))
        fresh = found.select(F.col("dst").alias("url"), F.col("m.src").alias("parent"), F.col("m.depth").alias("depth")).withColumn("score", score)
        front = _cut(front.unionByName(fresh).join(done.select("url"), "url", "left_anti").groupBy("url").agg(F.min(F.struct("depth", "parent", "score")).alias("m")).select("url", "m.parent", "m.depth", "m.score"))
        k += 1
    return done if done is not None else top


def _numbered(urls: DataFrame) -> DataFrame:
    """(url, id): the urls numbered from 0 by name, in a range-partitioned sort; one number a partition comes to the driver."""
    placed = _cut(urls.select("url").sort("url").select("url", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, at = [], 0
    for r in sizes:
        before.append((r["p"], at))
        at += r["n"]
    starts = placed.sparkSession.createDataFrame(before, "p bigint, at bigint")
    return placed.withColumn("p", part).join(F.broadcast(starts), "p").select("url", (F.col("at") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"))


def _walk(first, src, dst, n: int, max_depth: int):
    """Depth-first (page, parent or -1, depth) arrays over pages 0 to n - 1, from edges sorted by src and dst. Children wait as places in the edge table, so the stack is as long as the path."""
    import numpy as np

    offsets = np.searchsorted(src, np.arange(n + 1, dtype=np.int32)).astype(np.int64)
    ends, at, kids = memoryview(offsets)[1:], memoryview(offsets[:-1].copy()), memoryview(np.ascontiguousarray(dst))
    seen = bytearray(n)
    page, parent, depth = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int32)
    pages, parents, depths = memoryview(page), memoryview(parent), memoryview(depth)
    k = 0
    for root in first:
        if seen[root]:
            continue
        seen[root] = 1
        pages[k], parents[k], depths[k] = root, -1, 0
        k += 1
        path = [root] if max_depth > 0 else []
        while path:
            u = path[-1]
            i, end = at[u], ends[u]
            while i < end and seen[kids[i]]:
                i += 1
            if i == end:
                at[u] = i
                path.pop()
                continue
            v = kids[i]
            at[u] = i + 1
            seen[v] = 1
            pages[k], parents[k], depths[k] = v, u, len(path)
            k += 1
            if len(path) < max_depth:
                path.append(v)
    return page[:k], parent[:k], depth[:k]


def dfs(edges: DataFrame, starts: DataFrame, max_depth: int = 5, max_pages: int | None = 10_000) -> DataFrame:
    """(url, parent, depth, pos) in depth-first order, children by name; beyond max_pages reachable pages, if given, the function refuses.

    The order is sequential by nature: one task walks what breadth-first search reaches. Names are numbered on all executors and only
    numbers come to that task, batch by batch: about 30 bytes a page and 16 an edge.
    """
    edges = _cut(edges.select("src", "dst"))
    starts = _cut(starts.select("url").dropDuplicates(["url"]))
    reached = bfs(edges, starts, max_depth)
    n = reached.count()
    if max_pages is not None and n > max_pages:
        raise ValueError("more pages are reachable than max_pages; depth-first order isn't for whole crawls")
    ids = _cut(_numbered(reached))
    first = starts.join(ids, "url").select(F.lit(-1).alias("s"), F.col("id").alias("d"))
    own = edges.join(ids.select(F.col("url").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("url").alias("dst"), F.col("id").alias("d")), "dst").select("s", "d")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        src, dst = (np.concatenate([np.zeros(0, np.int32), *(p[c] for p in parts)]) for c in (0, 1))
        parts.clear()
        roots = int(np.searchsorted(src, 0))
        page, parent, depth = _walk(dst[:roots].tolist(), src[roots:], dst[roots:], n, max_depth)
        del src, dst
        for k in range(0, len(page), 1 << 16):
            at = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(page[at]), pa.array(parent[at], mask=parent[at] < 0), pa.array(depth[at]), pa.array(np.arange(k, k + len(page[at]), dtype=np.int32))], names=["id", "up", "depth", "pos"])

    order = _cut(first.unionByName(own).repartition(1).sortWithinPartitions("s", "d").mapInArrow(run, "id int, up int, depth int, pos int"))
    up = ids.select(F.col("id").alias("up"), F.col("url").alias("parent"))
    return order.join(ids, "id").join(up, "up", "left").select("url", "parent", "depth", "pos")
