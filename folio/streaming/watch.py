"""Files that change, as a stream: what folders hold, scan by scan, and a table of what is current.

The source's offset is a number, however many files there are: a batch is the listing of all
folders at its time, made by tasks. What is new, changed or gone is told by a join with the table that earlier batches
left, so only names and times are compared and only changed files are opened, by tasks and
at most so many a batch if there is a limit; what is left over differs still at the next scan.
"""

from __future__ import annotations

import fnmatch
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from folio.operators.rows import expand
from folio.sources.sink import opened
from folio.streaming.store import DELETED, Store

SCHEMA = "path string, mtime_ns long, size long, scan long"
#: Files that one batch opens, at most, where nothing else is asked for.
MAX_FILES = 100_000


@dataclass
class Branch(InputPartition):
    """A folder that one task lists, with all below it or without."""

    folder: str
    deep: bool
    scan: int


class WatchReader(DataSourceStreamReader):
    """The driver looks at the first level of folders only; the rest is listed by tasks."""

    def __init__(self, options: dict):
        self._folders, self._pattern = json.loads(options["folders"]), options.get("pattern", "*")
        self._recursive, self._last = options.get("recursive", "true") == "true", 0

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        self._last = max(time.time_ns() // 1_000_000, self._last + 1)
        return {"scan": self._last}

    def partitions(self, start: dict, end: dict) -> list[Branch]:
        from pyarrow.fs import FileSelector, FileType

        self._last = max(self._last, end["scan"])
        made = []
        for folder in self._folders:
            made.append(Branch(folder, False, end["scan"]))
            if self._recursive:
                fs, path = opened(folder)
                below = [i.base_name for i in fs.get_file_info(FileSelector(path)) if i.type == FileType.Directory and not i.base_name.startswith(".")]
                made += [Branch(f"{folder}/{name}", True, end["scan"]) for name in below]
        return made

    def read(self, branch: Branch) -> Iterator[tuple]:
        """Files without a hidden part below the folder. A folder that can't be listed is an error, not an empty one."""
        from pyarrow.fs import FileSelector, FileType

        fs, path = opened(branch.folder)
        for i in fs.get_file_info(FileSelector(path, recursive=branch.deep)):
            below = i.path[len(path) :].strip("/")
            if i.type == FileType.File and fnmatch.fnmatch(i.base_name, self._pattern) and not any(p.startswith(".") for p in below.split("/")):
                yield f"{branch.folder}/{below}", i.mtime_ns, i.size, branch.scan


class WatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "watch"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WatchReader(self.options)


def watch(spark: SparkSession, folders: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """A streaming DataFrame of ``path, mtime_ns, size, scan``: each batch is what the folders hold."""
    spark.dataSource.register(WatchSource)
    listed = [f.rstrip("/") for f in ([folders] if isinstance(folders, str) else folders)]
    return spark.readStream.format("watch").option("folders", json.dumps(listed)).option("pattern", pattern).option("recursive", str(recursive).lower()).load()


def contents(files: DataFrame) -> DataFrame:
    """``path, mtime_ns, content`` of ``path, mtime_ns`` rows, read by tasks; what can't be read is left out."""

    def read(row: dict) -> Iterator[tuple]:
        try:
            fs, path = opened(row["path"])
            with fs.open_input_stream(path) as f:
                yield row["path"], row["mtime_ns"], f.read()
        except OSError:
            return

    return expand(files.select("path", "mtime_ns"), read, "path string, mtime_ns long, content binary")


def changes(seen: DataFrame, known: DataFrame | None, batch: int, max_files: int | None) -> tuple[DataFrame, DataFrame]:
    """Files to open (``path, mtime_ns``), and paths that are gone. Under a limit, which files go first differs from batch to batch, so none waits for ever."""
    now = seen.groupBy("path").agg(F.max("mtime_ns").alias("mtime_ns"))
    if known is None:
        new, gone = now, now.where("false").select("path")
    else:
        old = known.where(~F.col(DELETED)).select("path", F.col("mtime_ns").alias("was"))
        both = now.join(old, "path", "full")
        new = both.where("mtime_ns is not null and (was is null or mtime_ns != was)").select("path", "mtime_ns")
        gone = both.where("mtime_ns is null").select("path")
    return new if max_files is None else new.orderBy(F.xxhash64("path", F.lit(batch)), "path").limit(max_files), gone


def latest(versions: DataFrame, key: str = "path", order: str = "mtime_ns", value: str = "content") -> DataFrame:
    """The latest version of each key; versions without a value leave the one before in place."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(value)))
    return versions.where(F.col(value).isNotNull()).withColumn("__n", newest).where("__n = 1").drop("__n")


def keep_latest(snapshots: DataFrame, store: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = MAX_FILES):
    """Write what a watched folder holds as a table of current files (``Store``), batch by batch; ``current`` reads it.

    A batch opens ``max_files`` at most and leaves the rest to later scans; ``None`` is no limit. A query that ends after one
    scan (``availableNow``) and is to leave nothing out needs ``None``: tasks stream what they read, so only their number is unbounded.
    A file that can't be read keeps its last version and is tried again at each scan; one that is gone leaves the table.
    A batch that runs again after a failure changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = Store(batch.sparkSession, store)
        opened_now, gone = changes(batch, kept.rows("mtime_ns", DELETED), number, max_files)
        rows = contents(opened_now.repartition(batch.sparkSession.sparkContext.defaultParallelism))
        made = rows.select("path", "mtime_ns").join(convert(rows), "path") if convert else rows
        kept.append(number, made.withColumn(DELETED, F.lit(False)).unionByName(gone.withColumn(DELETED, F.lit(True)), allowMissingColumns=True))

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Let a query run for a time, then stop it; whether it had ended by itself before."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The files that were there at the last batch, each in the latest version that could be read."""
    return Store(spark, store).current()
