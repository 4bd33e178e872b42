"""Rendered pages as files, one per path, by a Python data source: all of a job's files or none.

Tasks write drafts into folders of their own, with a list of what each draft is to become. Committing
writes one marker that names the lists of the tasks that count; a killed or repeated task leaves
nothing but drafts, and an aborted job takes them away. Then a Spark job renames drafts in
tasks. That can be done again by ``finish`` wherever it stopped, as the marker stays until all is done.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folio.operators.rows import expand

DRAFTS, MARKER, LIST = ".drafts-", "committed.json", "list.jsonl"
SCHEMA = "path string, html string"


def file_name(path: str) -> str:
    """Where a path's page goes, below the folder: its parts, none of which leads up or is hidden, and ``.html``."""
    parts = [quote(p, safe=" !()+,;=@[]{}~'&$") for p in path.split("/") if p not in ("", ".")]
    return "/".join("%2E" + p[1:] if p.startswith(".") else p for p in parts or ["%2E"]) + ".html"


def opened(folder: str):
    """A file system and the folder's path in it."""
    from pyarrow.fs import FileSystem

    local = re.sub("^file:/+", "/", folder)
    return FileSystem.from_uri(local if "://" in local else "file://" + local)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self._folder, self._job = options["path"].rstrip("/"), options.get("job") or uuid.uuid4().hex

    def _drafts(self):
        fs, folder = opened(self._folder)
        return fs, f"{folder}/{DRAFTS}{self._job}"

    def write(self, rows: Iterator) -> Written:
        fs, drafts = self._drafts()
        task = TaskContext.get()
        own, listed = f"{drafts}/{task.partitionId()}-{task.taskAttemptId()}", []
        fs.create_dir(own, recursive=True)
        for n, row in enumerate(rows):
            raw = (row["html"] or "").encode()
            with fs.open_output_stream(f"{own}/{n:09d}") as f:
                f.write(raw)
            listed.append(json.dumps({"draft": f"{own}/{n:09d}", "name": file_name(row["path"] or ""), "sha": hashlib.sha256(raw).hexdigest()}))
        with fs.open_output_stream(f"{own}/{LIST}") as f:
            f.write("\n".join(listed).encode())
        return Written(own, len(listed))

    def commit(self, messages: list) -> None:
        fs, drafts = self._drafts()
        fs.create_dir(drafts, recursive=True)
        with fs.open_output_stream(f"{drafts}/new-{MARKER}") as f:
            f.write(json.dumps([m.folder for m in messages if m]).encode())
        fs.move(f"{drafts}/new-{MARKER}", f"{drafts}/{MARKER}")

    def abort(self, messages: list) -> None:
        fs, drafts = self._drafts()
        fs.delete_dir_contents(drafts, missing_dir_ok=True)
        fs.delete_dir(drafts)


class PageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageWriter(self.options)


def unfinished(folder: str) -> dict[str, bool]:
    """Folders of drafts that are left, and whether their job had committed."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = opened(folder.rstrip("/"))
    found = [i.path for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if i.base_name.startswith(DRAFTS)]
    return {p: fs.get_file_info(f"{p}/{MARKER}").type == FileType.File for p in found}


def finish(spark: SparkSession, folder: str, discard: bool = False) -> int:
    """Rename what committed jobs left as drafts, and with ``discard`` remove drafts of jobs that never committed. Returns the number of files.

    Of equal paths the page of the greatest hash stays, in whatever order tasks ran.
    """
    fs, root = opened(folder.rstrip("/"))
    moved = 0
    for drafts, committed in unfinished(folder).items():
        if committed:
            with fs.open_input_stream(f"{drafts}/{MARKER}") as f:
                lists = json.loads(f.read())

            def read(row: dict) -> Iterator[tuple]:
                own, _ = opened(folder.rstrip("/"))
                with own.open_input_stream(f"{row['task']}/{LIST}") as f:
                    for line in f.read().decode().splitlines():
                        told = json.loads(line)
                        yield told["draft"], told["name"], told["sha"]

            def rename(row: dict) -> Iterator[tuple]:
                from pyarrow.fs import FileType

                own, _ = opened(folder.rstrip("/"))
                to = f"{root}/{row['name']}"
                if own.get_file_info(row["draft"]).type == FileType.File:  # else an earlier attempt did it
                    own.create_dir(to.rpartition("/")[0], recursive=True)
                    own.move(row["draft"], to)
                yield (row["name"],)

            listed = expand(spark.createDataFrame([(x,) for x in lists], "task string").repartition(max(1, len(lists))), read, "draft string, name string, sha string")
            first = listed.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("sha"), "draft"))).where("n = 1")
            moved += expand(first.select("draft", "name"), rename, "name string").count()
        if committed or discard:
            fs.delete_dir(drafts)
    return moved


def write_pages(pages: DataFrame, folder: str) -> int:
    """Write ``path, html`` rows as files below a folder that all tasks see; returns their number. Rows of equal paths give one file."""
    spark = pages.sparkSession
    spark.dataSource.register(PageSink)
    pages.select("path", "html").write.format("pages").mode("append").save(folder)
    return finish(spark, folder)
