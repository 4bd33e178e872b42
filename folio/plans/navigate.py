"""Opening one path, as following a link does: a folder becomes its listing, a file its page."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.render import render, render_listing
from folio.sources.corpus import read_corpus
from folio.sources.listing import read_listing


def opened(spark: SparkSession, path: str, offline: bool = False) -> DataFrame:
    """``path, html, url`` of a file or folder; an unreadable one is an empty table, so what was shown before stays."""
    if os.path.isdir(path):
        return render_listing(read_listing(spark, path), offline).select("path", "html", F.lit(None).cast("string").alias("url"))
    if not os.path.isfile(path):
        return spark.createDataFrame([], "path string, html string, url string")
    files = read_corpus(spark, path, recursive=False).where("error is null")
    shown = F.when(F.col("url").isNull(), F.col("html"))  # what has a url is shown from there
    return render(files, offline).select("path", shown.alias("html"), "url")
