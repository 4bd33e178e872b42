"""Whole trees of folders, on any file system that ``pyarrow.fs`` opens, as a Python data source that is dealt out
by prefixes and takes filters down: ``spark.read.format("tree").load(folder)``.

The driver goes down level by level only until there are prefixes enough for the tasks; a task walks through
its prefix folder by folder, so it holds one folder's entries. Filters on names, kinds, sizes and times are
applied there, before a row is made (``spark.sql.python.filterPushdown.enabled``); a filter on ``dir`` that no folder
of a prefix can meet spares the prefix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from folio.sources.listing import SCHEMA
from folio.sources.sink import opened

#: Prefixes that are wanted, and folders that the driver lists at most to get them.
PREFIXES, LISTED = 256, 64
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


@dataclass
class Prefix(D.InputPartition):
    folder: str
    deep: bool


def meets(f: D.Filter, value: object) -> bool:
    """Whether a value passes a filter on it; null passes none but ``is null``."""
    if isinstance(f, D.Not):
        return not meets(f.child, value)
    if isinstance(f, D.IsNull):
        return value is None
    if isinstance(f, D.IsNotNull):
        return value is not None
    if isinstance(f, D.In):
        return value in f.value
    tests = {
        D.EqualTo: lambda: value == f.value, D.EqualNullSafe: lambda: value == f.value, D.GreaterThan: lambda: value > f.value, D.GreaterThanOrEqual: lambda: value >= f.value, D.LessThan: lambda: value < f.value,
        D.LessThanOrEqual: lambda: value <= f.value, D.StringStartsWith: lambda: value.startswith(f.value), D.StringEndsWith: lambda: value.endswith(f.value), D.StringContains: lambda: f.value in value,
    }
    return tests[type(f)]()


def column(f: D.Filter) -> str | None:
    """The column of a filter that ``meets`` knows."""
    if isinstance(f, D.Not):
        return column(f.child)
    known = (D.EqualTo, D.EqualNullSafe, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual, D.StringStartsWith, D.StringEndsWith, D.StringContains, D.In, D.IsNull, D.IsNotNull)
    return f.attribute[0] if isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in COLUMNS else None


class TreeReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.hidden = options["path"].rstrip("/"), options.get("hidden", "false") == "true"
        self.filters: list[tuple[int, D.Filter]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            name = column(f)
            if name is None:
                yield f
            else:
                self.filters.append((COLUMNS.index(name), f))

    def _entries(self, folder: str) -> Iterator[tuple]:
        from pyarrow.fs import FileSelector, FileType

        fs, path = opened(folder)
        for i in sorted(fs.get_file_info(FileSelector(path)), key=lambda i: i.base_name):
            if self.hidden or not i.base_name.startswith("."):
                is_dir = i.type == FileType.Directory
                yield folder, i.base_name, is_dir, 0 if is_dir else i.size, i.mtime_ns or 0

    def _may_hold(self, folder: str) -> bool:
        """Whether folders from this one down can meet the filters on ``dir``."""
        starts = [f.value for k, f in self.filters if k == 0 and isinstance(f, (D.EqualTo, D.StringStartsWith))]
        return all(folder.startswith(s) or s.startswith(folder) for s in starts)

    def partitions(self) -> list[Prefix]:
        done, open_ = [], [self.folder]
        for _ in range(LISTED):
            if not open_ or len(open_) + len(done) >= PREFIXES:
                break
            folder = open_.pop(0)
            done.append(Prefix(folder, False))
            open_ += [f"{folder}/{name}" for _, name, is_dir, *_ in self._entries(folder) if is_dir and self._may_hold(f"{folder}/{name}")]
        return done + [Prefix(f, True) for f in open_]

    def read(self, prefix: Prefix) -> Iterator[tuple]:
        todo = [prefix.folder]
        while todo:
            folder = todo.pop()
            for row in self._entries(folder):
                if prefix.deep and row[2] and self._may_hold(f"{folder}/{row[1]}"):
                    todo.append(f"{folder}/{row[1]}")
                if all(meets(f, row[k]) for k, f in self.filters):
                    yield row


class TreeSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> D.DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, folder: str, hidden: bool = False) -> DataFrame:
    """``dir, name, is_dir, size, modified_ns`` of everything below a folder; filters of the query go down to the tasks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("hidden", str(hidden).lower()).load(folder)
