"""The public functions and table functions, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folio.functions.text import json_reindent, xml_decode
from folio.operators.containers import events, members
from folio.operators.delimited import MAX_ROWS, split_rows
from folio.operators.raster import raster_png
from folio.operators.richtext import runs


class CsvCells:
    """``csv_cells(text, delimiter)``."""

    def eval(self, text: str, delimiter: str) -> Iterator[tuple]:
        for row, col, value in split_rows(text or "", delimiter, MAX_ROWS):
            if value is not None:
                yield row, col, value


class RtfRuns:
    """``rtf_runs(content)``."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for seq, (para, kind, text, style) in enumerate(runs(bytes(content or b""))):
            yield seq, para, kind, text, *style


class DocParts:
    """``doc_parts(content, pattern)``: members of a ZIP container."""

    def eval(self, content: bytes, pattern: str) -> Iterator[tuple]:
        for name, declared, data in members(bytes(content or b""), pattern):
            yield name, declared, data, data is None


class DocNodes:
    """``doc_nodes(content, pattern)``: XML events of members of a ZIP container."""

    def eval(self, content: bytes, pattern: str) -> Iterator[tuple]:
        for name, _, data in members(bytes(content or b""), pattern):
            for k, (ev, tag, attrs, text) in enumerate(events((data or b"").decode("utf-8", "replace"))):
                yield name, k, ev, tag, attrs, text


TABLE_FUNCTIONS = {
    "csv_cells": (CsvCells, "row_idx int, col_idx int, value string"),
    "rtf_runs": (RtfRuns, "seq int, para int, kind string, text string, bold boolean, italic boolean, underline boolean"),
    "doc_parts": (DocParts, "part string, declared long, content binary, refused boolean"),
    "doc_nodes": (DocNodes, "part string, ev_id int, ev string, name string, attrs map<string,string>, text string"),
}
SAFE_LINK = r"""CREATE OR REPLACE TEMPORARY FUNCTION safe_link(url STRING) RETURNS BOOLEAN RETURN
regexp_extract(lower(regexp_replace(url, '[\\x00-\\x20\\x7F]', '')), '^([^/?#:]{0,30}:)', 1) IN ('', 'http:', 'https:', 'mailto:')"""


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``."""
    for name, f in {"json_reindent": json_reindent, "xml_decode": xml_decode, "raster_png": raster_png}.items():
        spark.udf.register(name, f)
    for name, (cls, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=schema))
    spark.sql(SAFE_LINK)
