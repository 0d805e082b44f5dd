"""Inputs and outputs: pages and documents from files, results to tables and files. Executors read and write; the driver only plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import PAGES


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """page_id, url, html from Parquet, ORC or JSON lines; the schema is given, so nothing is inferred."""
    return spark.read.schema(PAGES).format(kind).load(path)


def read_html_files(spark: SparkSession, path: str, root: str = "https://localhost/") -> DataFrame:
    """One row for each HTML file below path, with a fingerprint of its first 64 KB for deduplication."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.xxhash64("path").alias("page_id"), F.concat(F.lit(root), name).alias("url"), F.decode("content", "UTF-8").alias("html"), F.sha2(F.substring("content", 1, 65_536), 256).alias("fingerprint"), "length", "modificationTime")


def scan_errors(sources: DataFrame) -> DataFrame:
    """sources (url, html) with what is wrong with each; a bad one is a row with an error, and the others go on."""
    return sources.withColumn("error", F.coalesce(X.validate_url(F.col("url")), F.when(F.col("html").isNull(), F.lit("no content"))))


def write_bundles(docs: DataFrame, path: str, parts: int | None = None) -> None:
    """docs (doc_id, markdown, metadata columns) as a table of Markdown and JSON metadata, one row each, in `parts` files."""
    rest = [c for c in docs.columns if c not in ("doc_id", "markdown")]
    rows = docs.select("doc_id", "markdown", F.to_json(F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("metadata"))
    (rows.repartition(parts) if parts else rows).write.mode("overwrite").parquet(path)


def write_text(docs: DataFrame, column: str, path: str) -> None:
    docs.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(path)
