"""Operators on embeddings: near-copies, gaps, coverage, clouds, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and query points that meet in one group, and query points compared at a time within it.
ROWS, POINTS, AT_ONCE = 20_000, 5_000, 256


def _unit(column) -> np.ndarray:
    """Vectors of an Arrow list column as rows of length one; vectors of length nought stay nought."""
    flat = column.combine_chunks()
    flat = flat.flatten() if hasattr(flat, "flatten") else flat
    x = np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _in_blocks(rows: DataFrame, points: DataFrame, f, schema: str, key: str, vector: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """f(keys, unit vectors, point keys, unit vectors, table of the points) -> Arrow table, for every block of rows with every block of query points. Both sides are dealt to blocks of bounded size by hash; as long as there are POINTS points or fewer, each row goes to one block only."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    i, j = max(1, -(-rows.count() // ROWS)), max(1, -(-points.count() // POINTS))
    left = rows.select(key, vector, F.pmod(F.xxhash64(key), F.lit(i)).alias("_i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(j - 1).cast("bigint"))).alias("_j"))
    right = points.select(F.col(key).alias("q"), F.col(vector).alias("_v"), *extra, F.pmod(F.xxhash64(key), F.lit(j)).alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(i - 1).cast("bigint"))).alias("_i"))

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        return f(a.column(key).to_numpy(), _unit(a.column(vector)), b.column("q").to_numpy(), _unit(b.column("_v")), b).cast(out)

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(run, schema)


def nearest(rows: DataFrame, points: DataFrame, k: int = 1, but_self: bool = True, least: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, key, sim): of each query point the k most similar rows, by similarity (rounded to nine digits) and key; but_self: not the row of its own key.

    least: first the rows of that similarity or more by key, then the others by similarity. Only k rows of a block leave it.
    """
    import pyarrow as pa

    def block(keys, x, q, y, _):
        found = [[], [], []]
        for at in range(0, len(q), AT_ONCE):
            s = np.round(y[at : at + AT_ONCE] @ x.T, 9)
            for n, row in enumerate(s):
                own = np.flatnonzero(keys != q[at + n]) if but_self else np.arange(len(keys))
                order = -row[own] if least is None else np.where(row[own] >= least, -2 + 0 * row[own], -row[own])
                if len(own) > k:
                    bar = np.partition(order, k - 1)[k - 1]
                    near = order <= bar
                    own, order = own[near], order[near]
                pick = own[np.lexsort((keys[own], order))[:k]]
                found[0].append(np.full(len(pick), q[at + n]))
                found[1].append(keys[pick])
                found[2].append(row[pick])
        return pa.table({n: np.concatenate(c) for n, c in zip(("q", key, "sim"), found, strict=True)})

    kind = rows.schema[key].dataType.simpleString()
    parts = _in_blocks(rows, points, block, f"q {kind}, `{key}` {kind}, sim double", key, vector)
    order = [F.desc("sim"), key] if least is None else [F.desc(F.col("sim") >= least), F.when(F.col("sim") >= least, F.col(key)), F.desc("sim"), key]
    return parts.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def gaps(rows: DataFrame, points: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, gap): the distance of each query point to its nearest other row; 1 without rows."""
    near = nearest(rows, points, key=key, vector=vector).select("q", "sim")
    return points.select(F.col(key).alias("q")).join(near, "q", "left").select("q", F.coalesce(1 - F.col("sim"), F.lit(1.0)).alias("gap"))


def coverage(gaps_: DataFrame, within: float = 0.3) -> DataFrame:
    """One row (mean_best, median_best, hit_rate) over gaps()."""
    best = 1 - F.col("gap")
    return gaps_.agg(F.avg(best).alias("mean_best"), F.median(best).alias("median_best"), F.avg((F.col("gap") <= within).cast("double")).alias("hit_rate"))


def cloud(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(dim, mean, std) of a set of vectors."""
    d = vectors.select(F.posexplode(vector).alias("dim", "x"))
    return d.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def radius(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row (n, mean, most): the distances of a set of vectors from their centroid."""
    x = F.transform(vector, lambda v: v.cast("double"))
    dims = vectors.select(F.posexplode(x).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x"))  # a row a dimension
    centre = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("centre"))
    away = F.sqrt(F.aggregate(F.zip_with(x, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return vectors.crossJoin(F.broadcast(centre)).select(away.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.max("r").alias("most"))


def without_near_copies(new: DataFrame, kb: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The new vectors whose best cosine with another row of the knowledge base is under least."""
    near = nearest(kb, new, key=key, vector=vector).where(F.col("sim") >= least).select(F.col("q").alias(key))
    return new.join(near, key, "left_anti")


def gap_link_scores(links: DataFrame, gaps_: DataFrame, points: DataFrame, known: DataFrame, key: str = "vec_id", vector: str = "embedding", needs: float = 0.2, too_like: float = 0.85) -> DataFrame:
    """(key, score): how much each link would close the gaps of the query points that are wider than needs, less a penalty for links that say what is known (known: a set of points like the query points). A row a link leaves each block."""
    import pyarrow as pa

    def gain(keys, x, q, y, t):
        gap = t.column("gap").to_numpy()
        total = np.zeros(len(keys))
        for at in range(0, len(q), AT_ONCE):
            total += np.maximum(0, gap[at : at + AT_ONCE, None] - (1 - y[at : at + AT_ONCE] @ x.T)).sum(0) * 2
        return pa.table({key: keys, "total": total, "n": np.full(len(keys), len(q))})

    def like(keys, x, q, y, _):
        most = np.full(len(keys), -1.0)
        for at in range(0, len(q), AT_ONCE):
            s = y[at : at + AT_ONCE] @ x.T
            s[q[at : at + AT_ONCE, None] == keys[None, :]] = -1
            most = np.maximum(most, s.max(0))
        return pa.table({key: keys, "most": most})

    kind = links.schema[key].dataType.simpleString()
    open_ = points.join(gaps_.where(F.col("gap") > needs).select(F.col("q").alias(key), "gap"), key)
    gained = _in_blocks(links, open_, gain, f"`{key}` {kind}, total double, n bigint", key, vector, ("gap",)).groupBy(key).agg((F.sum("total") / F.sum("n")).alias("gain"))
    liked = _in_blocks(links, known, like, f"`{key}` {kind}, most double", key, vector).groupBy(key).agg(F.max("most").alias("like"))
    return gained.join(liked, key, "left").select(key, (F.col("gain") * (1 - 2 * F.greatest(F.lit(0.0), F.coalesce("like", F.lit(0.0)) - too_like))).alias("score"))


def cluster(vectors: DataFrame, by: str, key: str = "vec_id", vector: str = "embedding", most_apart: float = 0.3, most_rows: int = 3000) -> DataFrame:
    """(by, key, cluster): Ward clustering of each group's vectors by their cosine distances, cut at most_apart. A group is a page's chunks; one of more than most_rows raises an error rather than being cut."""

    def run(pdf):
        if len(pdf) > most_rows:
            raise ValueError(f"a group of {len(pdf)} rows is too large to be clustered in one task")
        x = np.stack(pdf[vector].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        pdf = pdf[[by, key]].copy()
        pdf["cluster"] = ward(1 - x @ x.T, most_apart)
        return pdf

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select(by, key, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, cluster int")


def ward(d: np.ndarray, most: float) -> np.ndarray:
    """Labels of an agglomeration by the Lance-Williams update for Ward's method, stopped at distance most; numbered by first member."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] > most:
            break
        k = alive.copy()
        k[[i, j]] = False
        t = size[i] + size[j] + size[k]
        new = np.sqrt(np.maximum(((size[i] + size[k]) * d[i, k] ** 2 + (size[j] + size[k]) * d[j, k] ** 2 - size[k] * d[i, j] ** 2) / t, 0))
        d[i, k] = d[k, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1].astype("int32")
