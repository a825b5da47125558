"""Streams: windows over events, keyed deduplication, and the back-off state of each domain. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _watermarked(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Event times of a stream must carry a zone; those without one are read in the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if rows.isStreaming else rows


def timeline(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows."""
    rows = _watermarked(events, ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    rows = _watermarked(events, ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unseen(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once; on a stream, the state of a key is dropped when the watermark has passed it."""
    return _watermarked(stream, ts, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def endpoint_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.avg((F.col("value") >= 0).cast("double")).alias("ok"))


def backoff(delay: float, fails: int, status: int, jitter: float = 1.0, base: float = 1.0, most: float = 60.0, retries: int = 3) -> tuple[float, int, bool]:
    """The next (delay, fails, goes on) of a domain after a response: refusals double the delay, successes shrink it by a quarter."""
    if status in (429, 503):
        fails += 1
        return min(max(delay, base) * 2 * jitter, most), fails, fails <= retries
    return max(base, delay * 0.75), 0, True


def rate_states(responses: DataFrame, key: str = "domain", ts: str = "ts", status: str = "status", base: float = 1.0) -> DataFrame:
    """(key, ts, delay, fails, goes_on) after each response. On a stream the state is kept by key; a batch is folded in order, without holding a key's rows. A state follows from the one before, so the responses of one domain, however many, are gone through by one task."""
    import pandas as pd

    schema = f"{key} string, {ts} timestamp, delay double, fails int, goes_on boolean"
    if responses.isStreaming:
        from pyspark.sql.streaming.state import GroupStateTimeout

        def step(k, frames, state):
            delay, fails = state.get if state.exists else (base, 0)
            for f in frames:
                out = []
                for r in f.sort_values(ts).itertuples(index=False):
                    delay, fails, on = backoff(delay, fails, getattr(r, status), base=base)
                    out.append((k[0], getattr(r, ts), delay, fails, on))
                yield pd.DataFrame(out, columns=[key, ts, "delay", "fails", "goes_on"])
            state.update((delay, fails))

        return responses.withColumn(ts, F.col(ts).cast("timestamp")).groupBy(key).applyInPandasWithState(step, schema, "delay double, fails int", "append", GroupStateTimeout.NoTimeout)

    def fold(frames):
        now, delay, fails = None, base, 0
        for f in frames:
            out = []
            for k, t, s in zip(f[key], f[ts], f[status], strict=True):
                if k != now:
                    now, delay, fails = k, base, 0
                delay, fails, on = backoff(delay, fails, s, base=base)
                out.append((k, t, delay, fails, on))
            yield pd.DataFrame(out, columns=[key, ts, "delay", "fails", "goes_on"])

    ordered = responses.select(key, F.col(ts).cast("timestamp").alias(ts), status).repartition(key).sortWithinPartitions(key, ts)
    return ordered.mapInPandas(fold, schema)


def aged_priority(priority: Column, waited: Column, fair_after: float = 600.0) -> Column:
    """Who waits longer than fair_after seconds goes first, the longest first."""
    return F.when(waited > fair_after, -waited).otherwise(priority.cast("double"))


def round_robin(rows: DataFrame, proxies: list[str], order: str) -> DataFrame:
    """Deal proxies to rows in turn. The turn is the place in the order, counted by partition and then shifted, so no task holds all rows."""
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    turn = F.pmod(local + F.col("_before"), F.lit(len(proxies))).cast("int")
    return parts.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("proxy", F.get(F.array(*map(F.lit, proxies)), turn)).drop("_p", "_m", "_before")


def token_totals(usage: DataFrame, by: str, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """(by, calls, prompt, completion, total) of token counts a call."""
    return usage.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum(prompt).alias("prompt"), F.sum(completion).alias("completion"), F.sum(F.col(prompt) + F.col(completion)).alias("total"))


def queue_state(tasks: DataFrame, status: str = "status", waited: str = "waited") -> DataFrame:
    """One row: how many tasks are queued, active and done, and the mean and longest wait of those queued."""
    queued = F.col(status) == "queued"
    count = lambda s: F.count_if(F.col(status) == s).alias(s)
    return tasks.agg(count("queued"), count("active"), count("done"), F.avg(F.when(queued, F.col(waited))).alias("mean_wait"), F.max(F.when(queued, F.col(waited))).alias("longest_wait"))
