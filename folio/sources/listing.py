"""Folders as rows, by a Python data source: ``spark.read.format("listing").load(folder)``."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folio.functions.text import escape_html, human_size, join_path
from folio.operators.rows import expand
from folio.sources.work import stored

SCHEMA = "dir string, name string, is_dir boolean, size long, modified_ns long"


def entries(folder: str) -> Iterator[tuple]:
    """Entries without a leading dot. Links count as what they lead to; one that leads nowhere as an empty file."""
    for name in sorted(os.listdir(folder)):
        if not name.startswith("."):
            path = os.path.join(folder, name)
            try:
                found = os.stat(path)
                is_dir = stat.S_ISDIR(found.st_mode)
                yield folder, name, is_dir, 0 if is_dir else found.st_size, found.st_mtime_ns
            except OSError:
                yield folder, name, False, 0, 0


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self._folders = [p for p in (options.get("paths") or options.get("path") or "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        """One partition per folder."""
        return [Folder(f) for f in self._folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return entries(partition.path)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


def read_listing(spark: SparkSession, folder: str | Path, recursive: bool = False) -> DataFrame:
    """The entries of a folder, or of a whole tree, in their order.

    A tree is listed level by level: the folders of a level are rows, which tasks list. The
    driver sees only whether a level is empty. Links to folders are listed, but not followed down.
    Remote folders (``hdfs://``, ``s3a://``) are listed by their Hadoop file system, without recursion.
    """
    name = str(folder)
    if "://" in name and not name.startswith("file://"):
        return ordered(remote_entries(spark, name))
    spark.dataSource.register(ListingSource)
    level = spark.read.format("listing").load(name.removeprefix("file://"))
    if not recursive:
        return ordered(level)
    every = level = stored(level, "listing")
    while not (below := level.where("is_dir")).isEmpty():
        folders = below.select(join_path(F.col("dir"), F.col("name")).alias("path")).repartition(spark.sparkContext.defaultParallelism)
        level = stored(expand(folders, lambda row: entries(row["path"]) if not os.path.islink(row["path"]) else (), SCHEMA), "listing")
        every = every.unionByName(level)
    return ordered(every)


def remote_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a folder of any file system that Hadoop knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(folder, s.getPath().getName(), s.isDirectory(), 0 if s.isDirectory() else s.getLen(), s.getModificationTime() * 1_000_000) for s in found]
    return spark.createDataFrame([r for r in rows if not r[1].startswith(".")], SCHEMA)


def ordered(entries: DataFrame) -> DataFrame:
    """Folders first, then by name in byte order; with the path and what stands beside the name."""
    return with_notes(entries).orderBy("dir", F.desc("is_dir"), "name")


def with_notes(entries: DataFrame) -> DataFrame:
    """Adds the path, what stands beside the name, and the entry's place in its folder."""
    note = F.when(F.col("is_dir"), "folder").otherwise(human_size(F.col("size")))
    place = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("is_dir"), "name"))
    return entries.withColumns({"path": join_path(F.col("dir"), F.col("name")), "note": note, "place": place})


def listing_row() -> Column:
    """An entry as HTML."""
    slash = F.when(F.col("is_dir"), "/").otherwise("")
    css = F.when(F.col("is_dir"), "dir").otherwise("file")
    return F.concat(F.lit('<li class="'), css, F.lit('" data-path="'), escape_html(F.col("path")), F.lit('"><span class="name">'), escape_html(F.col("name")), slash, F.lit('</span><span class="size">'), "note", F.lit("</span></li>"))
