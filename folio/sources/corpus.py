"""Files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.classify import classify

#: Larger files are listed with an error instead of being read.
MAX_BYTES = 1 << 30


def read_corpus(spark: SparkSession, path: str | list[str], recursive: bool = True, pattern: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, modified, length, content, error`` of all files below a path.

    Files over ``max_bytes`` have no content and an error. The content column is read
    only where a query uses it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    every = reader.load(path)
    large = F.col("length") > max_bytes
    content = F.when(~large, F.col("content"))
    named = F.regexp_replace("path", "^file:/+", "/")
    return every.where(~large).unionByName(every.where(large)).select(named.alias("path"), F.col("modificationTime").alias("modified"), "length", content.alias("content"), F.when(large, "file too large").alias("error"))


def from_texts(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """A corpus from a table: ``path, content``."""
    return df.select(path.cast("string").alias("path"), F.encode(text.cast("string"), "UTF-8").alias("content"))


def texts(files: DataFrame) -> DataFrame:
    """``path, text``; bytes that are no UTF-8 are replaced."""
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def classified(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return classify(read_corpus(spark, path, **options))
