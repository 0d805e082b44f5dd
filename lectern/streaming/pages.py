"""The page operators on a stream: every parse is a function of its row, so the batch code runs unchanged; only the removal of
repeated URLs keeps state, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import web

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Pages that arrive as Parquet files; the files of one trigger are the rate limit."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def page_links(pages: DataFrame) -> DataFrame:
    return web.discover_links(pages)


def first_seen(pages: DataFrame, seen_at: str, lateness: str = "1 hour") -> DataFrame:
    """One row for each URL within the lateness; state older than that is dropped."""
    return pages.withWatermark(seen_at, lateness).dropDuplicatesWithinWatermark(["url"])


def link_counts(pages: DataFrame) -> DataFrame:
    """Running counts of links by site; in update or complete mode."""
    links = web.perceive(pages, "links").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain"), F.size("links").cast("bigint").alias("n"))
    return links.groupBy("domain").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, run to its end into a table in memory (for tests and small checks)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
