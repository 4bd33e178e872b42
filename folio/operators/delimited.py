"""Delimited text as a table of cells."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import extension
from folio.operators.rows import expand

#: Rows of a file, its header included.
MAX_ROWS = 10_000


def sniffed_delimiter(ext: Column, text: Column) -> Column:
    """Tab for tsv; else the delimiter of the first line outside quotes: tab if it leads both others, then semicolon before comma."""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), r'"[^"]*("|$)', "")
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    commas, semicolons, tabs = count(","), count(";"), count("\t")
    return F.when((ext == "tsv") | ((tabs > commas) & (tabs > semicolons)), "\t").when(semicolons > commas, ";").otherwise(",")


def split_rows(text: str, delimiter: str, max_rows: int | None = MAX_ROWS) -> Iterator[tuple[int, int, str | None]]:
    """Row, column and value of each cell; the row ``max_rows`` stands alone, without value, if there is more.

    A field is quoted only if a quote is its first character; what stands between its
    closing quote and the next delimiter is dropped. Lines end in LF, CR LF or CR. A
    delimiter at the end of the text opens no cell.
    """
    d = re.escape(delimiter)
    field = re.compile(rf'"((?:[^"]++|"")*+)(?:"[^{d}\r\n]*|\Z)|([^{d}\r\n]*)')
    at = row = col = 0
    while at < len(text):
        if max_rows is not None and row >= max_rows:
            yield row, 0, None
            return
        m = field.match(text, at)
        yield row, col, m[1].replace('""', '"') if m[1] is not None else m[2]
        at = m.end()
        if at < len(text) and text[at] == delimiter:
            at, col = at + 1, col + 1
        else:
            at += 2 if text.startswith("\r\n", at) else 1
            row, col = row + 1, 0


def csv_cells(files: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """``path, row_idx, col_idx, value, is_header, truncated`` of ``path, content`` rows, a row per cell.

    The row limit (none for no limit) goes down into the reader, which stops there. ``truncated`` marks the
    cells of a file with more rows. The reader learns that at the end only, so it goes over the
    rows of such a long file twice; nothing is shuffled.
    """
    decoded = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    told = decoded.withColumn("delimiter", sniffed_delimiter(extension(F.col("path")), F.col("text")))

    def read(row: dict) -> Iterator[tuple]:
        text = row["text"] or ""
        # a file with fewer line ends than rows allowed can't have more rows
        may = max_rows is not None and text.count("\n") + text.count("\r") >= max_rows
        more = may and any(value is None for _, _, value in split_rows(text, row["delimiter"], max_rows))
        for r, c, value in split_rows(text, row["delimiter"], max_rows):
            if value is not None:
                yield row["path"], r, c, value, r == 0, more

    return expand(told, read, "path string, row_idx int, col_idx int, value string, is_header boolean, truncated boolean")
