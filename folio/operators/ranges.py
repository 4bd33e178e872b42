"""One large delimited file, read by many tasks.

Spark's text reader deals a file out in ranges of whole lines; but a line may lie inside a quoted
cell, which only the ranges before can tell. So there are two passes, without a shuffle of the text:

1. Each range is gone over for both states that it may begin in, inside a quoted cell or at a row; it tells
   how it ends, how many rows end in it, and in which column.
2. Windows over the ranges of a file (a row each) pick the states: what a range does to the state is to
   set, keep or turn it, so the last one that set it and the number of turns since then tell it.
3. Each range is read once more from its state, row and column on. Cells that go over the end of
   a range come as pieces, and only pieces are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from folio.functions.text import extension
from folio.operators.delimited import sniffed_delimiter
from folio.operators.rows import BATCH_BYTES, BATCH_ROWS, joined
from folio.sources.work import stored

#: Ranges up to which their states (some 50 bytes each) are broadcast; with more, lines are shuffled to them.
BROADCAST_RANGES = 500_000
SUMMARY = "kind int, path string, start long, bytes long, size long, inside0 boolean, inside1 boolean, row0 long, row1 long, col0 long, col1 long, value string, tail boolean"
CELLS = "path string, row_idx long, col_idx long, value string"


class Scanner:
    """Goes over lines from a state on. ``feed`` yields (row, column, value) of the cells that begin and end in its range;
    ``head`` is the end of a cell from before, ``tail`` what there is of a cell that goes on."""

    def __init__(self, delimiter: str, inside: bool = False, row: int = 0, col: int = 0):
        d = re.escape(delimiter)
        self.field = re.compile(rf'"((?:[^"]++|"")*+)(?:("[^{d}\r\n]*)|\Z)|([^{d}\r\n]*)')
        self.rest = re.compile(rf'((?:[^"]++|"")*+)(?:("[^{d}\r\n]*)|\Z)')
        self.delimiter, self.inside, self.row, self.col = delimiter, inside, row, col
        self.cut, self.head, self.held = inside, None, []

    def feed(self, line: str) -> Iterator[tuple[int, int, str]]:
        """A line with its end; without one only at the end of the text."""
        at, n = 0, len(line)
        while at < n:
            going_on = self.inside
            m = (self.rest if going_on else self.field).match(line, at)
            quoted = going_on or m[1] is not None
            self.inside = quoted and m[2] is None
            value = m[1].replace('""', '"') if quoted else m[3]
            at = m.end()
            if self.inside:
                self.held.append(value)
                return
            if going_on:
                self.held.append(value)
                value, self.held = "".join(self.held), []
            if self.cut:
                self.head, self.cut = value, False
            else:
                yield self.row, self.col, value
            if at < n and line[at] == self.delimiter:
                at, self.col = at + 1, self.col + 1
            elif at < n:
                at += 2 if line.startswith("\r\n", at) else 1
                self.row, self.col = self.row + 1, 0

    def tail(self) -> str:
        return "".join(self.held)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file, the start of the range that holds them, and their bytes with the end."""
    meta = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    return meta.select(F.col("file_path").alias("path"), F.col("file_block_start").alias("start"), F.col("file_size").alias("size"), F.make_valid_utf8("value").alias("line"), (F.octet_length("value") + 1).alias("bytes"))


def in_ranges(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of a task as (path, start) with the rows of that range, which lie side by side."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    now = next(rows, None)

    def of(key: tuple) -> Iterator[tuple]:
        nonlocal now
        while now is not None and now[:2] == key:
            yield now
            now = next(rows, None)

    while now is not None:
        yield now[:2], of(now[:2])


def summaries(lines: DataFrame, delimiter: str) -> DataFrame:
    """What each range does from either state (kind 0), and the pieces of cells at its ends (kind 1) with their places from either."""
    schema = to_arrow_schema(StructType.fromDDL(SUMMARY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), rows in in_ranges(batches, ["path", "start", "size", "line", "bytes"]):
            a, b, n, size, ahead = Scanner(delimiter), Scanner(delimiter, True), 0, 0, None
            for _, _, size, line, length in rows:
                n += length
                for scanner in (a, b) if ahead is None else (a,):
                    for _ in scanner.feed(line + "\n"):
                        pass
                if ahead is None and not a.inside and not b.inside:
                    ahead = b.row - a.row  # both stand at the start of a row: from here on they do the same
            end = (a.inside, a.row + ahead, a.col) if ahead is not None else (b.inside, b.row, b.col)
            told = {"path": path, "start": start}
            made = [told | {"kind": 0, "bytes": n, "size": size, "inside0": a.inside, "inside1": end[0], "row0": a.row, "row1": end[1], "col0": a.col, "col1": end[2]}]
            if b.head is not None:
                made.append(told | {"kind": 1, "row1": 0, "col1": 0, "value": b.head, "tail": False})
            if a.inside:
                made.append(told | {"kind": 1, "row0": a.row, "col0": a.col, "value": a.tail(), "tail": True} | ({"row1": end[1], "col1": end[2]} if ahead is not None else {}))
            if ahead is None and b.inside:
                made.append(told | {"kind": 1, "row1": b.row, "col1": b.col, "value": b.tail(), "tail": True})
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return lines.select("path", "start", "size", "line", "bytes").mapInArrow(run, SUMMARY)


def states(told: DataFrame) -> DataFrame:
    """``path, start, inside, row, col, unended``: where each range begins, and whether it ends the text without a line end."""
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("inside0") & ~F.col("inside1"), 1).otherwise(0))
    marked = told.withColumn("turns", turns.over(order)).withColumn("set", F.when(F.col("inside0") == F.col("inside1"), F.struct("inside0", "turns")))
    last = F.last("set", ignorenulls=True).over(before)
    turned = F.coalesce(F.lag("turns").over(order), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    inside = F.coalesce(last["inside0"], F.lit(False)) != (turned % 2 == 1)
    chosen = marked.withColumn("inside", inside)
    for c in ("row", "col"):
        chosen = chosen.withColumn(c, F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")))
    # a column counts on from the range before, unless a row ended in this one
    anew = F.when(F.col("inside") & (F.col("row") == 0), 0).otherwise(1)
    grouped = chosen.withColumn("anew", F.sum(anew).over(order)).withColumn("after", F.sum("col").over(Window.partitionBy("path", "anew").orderBy("start")))
    whole = Window.partitionBy("path")
    beyond = F.sum("bytes").over(whole) - F.col("size")  # one end too many; or that and three bytes of a mark at the start too few
    unended = beyond.isin(1, -2) & (F.col("start") == F.max("start").over(whole))
    rows_before, col = F.coalesce(F.sum("row").over(before), F.lit(0)), F.coalesce(F.lag("after").over(order), F.lit(0))
    return grouped.select("path", "start", "inside", rows_before.alias("row"), F.when(F.col("inside"), col).otherwise(0).alias("col"), unended.alias("unended"))


def cells_within(lines: DataFrame, delimiter: str) -> DataFrame:
    """The cells that begin and end in one range, of lines that know where their range begins."""
    schema = to_arrow_schema(StructType.fromDDL(CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, _), rows in in_ranges(batches, ["path", "start", "line", "inside", "row", "col", "unended"]):
            scanner, made, size, now = None, [], 0, next(rows)
            while now is not None:
                after = next(rows, None)
                _, _, line, inside, row, col, unended = now
                scanner = scanner or Scanner(delimiter, inside, row, col)
                for cell in scanner.feed(line if unended and after is None else line + "\n"):
                    made.append((path, *cell))
                    size += len(cell[2])
                if made and (after is None or len(made) >= BATCH_ROWS or size >= BATCH_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                    made, size = [], 0
                now = after

    return lines.mapInArrow(run, CELLS)


def whole_pieces(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """Cells that go over the ends of ranges, from the pieces that belong to the states that ranges begin in."""
    met = pieces.select("path", "start", "row0", "row1", "col0", "col1", "value", "tail").join(known, ["path", "start"])
    row, col = (F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) for c in ("row", "col"))
    placed = met.select("path", "start", row.alias("r"), col.alias("c"), *(F.col(c) for c in ("row", "col", "inside", "value", "tail", "unended"))).where("r is not null")
    value = F.when(F.col("unended") & F.col("tail"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    goes_on = F.col("inside") & (F.col("r") == 0)
    cells = placed.select("path", "start", (F.col("row") + F.col("r")).alias("row_idx"), (F.when(goes_on, F.col("col")).otherwise(0) + F.col("c")).alias("col_idx"), value.alias("value"))
    return cells.groupBy("path", "row_idx", "col_idx").agg(joined("value", "start").alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds the place of each line in its range, for when they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            nth = []
            for key in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                now, n = key, n + 1 if key == now else 0
                nth.append(n)
            yield batch.append_column("nth", pa.array(nth, pa.int64()))

    return lines.mapInArrow(run, StructType([*lines.schema.fields, StructField("nth", LongType())]))


def large_csv_cells(spark: SparkSession, path: str, delimiter: str | None = None, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """``path, row_idx, col_idx, value, is_header`` of a delimited file, or of the files of a folder, in any number of tasks.

    The cells are those of ``csv_cells`` without a row limit. Without a delimiter that of the first
    line is taken, as there, for all files. An empty file has no cells.
    """
    if delimiter is None:
        first = spark.read.option("lineSep", "\n").text(path).limit(1).select(sniffed_delimiter(extension(F.lit(path)), F.col("value")).alias("d")).first()
        delimiter = first.d if first else ","
    lines = lines_of(spark, path)
    told = stored(summaries(lines, delimiter), "ranges", by="kind")
    known = stored(states(told.where("kind = 0")), "states")
    texts = lines.select("path", "start", "line")
    if known.count() <= broadcast_ranges:
        met = texts.join(F.broadcast(known), ["path", "start"])
    else:
        met = numbered(texts).join(known.hint("shuffle_merge"), ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "nth")
    within = cells_within(met.select("path", "start", "line", "inside", "row", "col", "unended"), delimiter)
    cells = within.unionByName(whole_pieces(told.where("kind = 1"), known))
    return cells.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "row_idx", "col_idx", "value", (F.col("row_idx") == 0).alias("is_header"))
