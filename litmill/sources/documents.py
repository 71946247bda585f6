"""Documents from folders, and state from tolerant JSON files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.text import strip, title_of_filename

TASKS = "id string, type string, status string, created_at string, updated_at string, message string, retries int, cancel_requested boolean, payload struct<paper:struct<title:string>>"
WATCHES = "id string, query string, watch_type string, source string, frequency string, enabled boolean, created_at timestamp, last_run timestamp, next_run timestamp"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, content) of the PDF files of a folder, read lazily where content is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", title_of_filename(F.col("path")).alias("title"), "content")


def extract(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_no, page_text) by a pluggable extractor; a file it fails on has one page of null text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, k, t) for k, t in enumerate(pages_of(content))] or [(path, 0, "")]
                except Exception:  # noqa: BLE001 - any file may be broken
                    rows.append((path, 0, None))
            yield pd.DataFrame(rows, columns=["path", "page_no", "page_text"])

    return files.select("path", "content").mapInPandas(each, "path string, page_no int, page_text string")


def empty_documents(pages: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """(key, chars): documents of which all pages together have less than `least` characters."""
    return pages.groupBy(key).agg(F.sum(F.length(strip(F.coalesce(F.col(text), F.lit(""))))).alias("chars")).where(F.col("chars") < least)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON state file; what cannot be read becomes null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
