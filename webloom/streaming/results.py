"""Results as they come: page features over a stream of files, with the functions that batch tables take."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import scrape


def scrape_stream(spark: SparkSession, source: str, out: str, checkpoint: str, wanted: Iterable[str] = ("markdown",), files_a_batch: int = 100) -> StreamingQuery:
    """Read page files (parquet: page_id, html) that have arrived in source since the last run, and append their features to out; each file once, also after a failure. The query ends when all that is there has been read."""
    pages = spark.readStream.schema("page_id bigint, html string").option("maxFilesPerTrigger", files_a_batch).parquet(source)
    features = scrape.scrape(pages, wanted)
    return features.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
