"""Workbooks (xlsx) as tables: sheets, shared strings, styles and cells, resolved by joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import builtin_format, custom_format, leading_number, percent_text, serial_text
from folio.operators.containers import BUDGET, Container, relations
from folio.operators.office import NO_PART, NO_ZIP, number
from folio.operators.rows import expand, first_match
from folio.sources.work import stored

MAX_SHEETS, MAX_ROWS, MAX_COLS = 16, 5_000, 256

XLSX = "path string, kind string, sheet_idx int, sheet_name string, row_idx int, col_idx int, gap int, cell_type string, style int, text string, truncated boolean"


def column(ref: str) -> int:
    """The 0-based column of a cell reference (its first four capitals at most), -1 without capitals."""
    value = 0
    for c in ref[:4]:
        if not "A" <= c <= "Z":
            break
        value = value * 26 + ord(c) - 64
    return value - 1


def shared_strings(archive: Container) -> Iterator[str]:
    """The text of ``t`` in ``si``, without phonetic runs."""
    said: list[str] | None = None
    on: set[str] = set()
    for ev, name, _, text in archive.xml("xl/sharedStrings.xml"):
        if name == "si":
            if ev == "end" and said is not None:
                yield "".join(said)
            said = [] if ev == "start" else None
        elif name in ("t", "rPh"):
            (on.add if ev == "start" else on.discard)(name)
        elif ev == "text" and said is not None and on == {"t"}:
            said.append(text)


def sheet_cells(archive: Container, part: str, max_rows: int | None, max_cols: int | None) -> Iterator[tuple[int, int, int, str, int, str] | tuple[int, bool]]:
    """Row, place, empty cells before it, type, style and text of each cell; at last the rows and whether there are more.

    A cell stands at its reference if that is valid, else after the cell before; columns
    that are left out become empty cells.
    """
    row, place, free, at, cell, on = -1, 0, 0, 0, None, set()
    for ev, name, attrs, text in archive.xml(part):
        opens = ev in ("start", "empty")
        if name == "row":
            if opens:
                if max_rows is not None and row + 1 >= max_rows:
                    yield row + 1, True
                    return
                row, place, free = row + 1, 0, 0
            on = {"row"} if ev == "start" else set()
        elif "row" not in on:
            continue
        elif name == "c":
            if opens:
                ref = column(attrs["r"]) if "r" in attrs else free
                at = ref if 0 <= ref and (max_cols is None or ref < max_cols) else free
                gap = max(0, at - free)
                cell = [row, place + gap, gap, attrs.get("t", ""), number(attrs["s"]) if "s" in attrs else -1, ""]
                if ev == "empty":
                    yield tuple(cell)
                    place, free, cell = cell[1] + 1, free + gap + 1, None
            elif cell is not None:
                yield tuple(cell)
                place, free, cell = cell[1] + 1, at + 1, None
        elif name in ("v", "is") or (name == "t" and ("is" in on or ev == "end")):
            (on.add if ev == "start" else on.discard)(name)
        elif ev == "text" and cell is not None and ("v" in on or {"is", "t"} <= on):
            cell[-1] += text
    yield row + 1, False


def xlsx_rows(path: str, content: bytes | None, max_sheets: int | None, max_rows: int | None, max_cols: int | None, budget: int = BUDGET) -> Iterator[tuple]:
    archive = Container(content, budget)

    def told(kind: str, sheet: int | None = None, name: str | None = None, row: int | None = None, col: int | None = None, gap: int | None = None, cell_type: str | None = None, style: int | None = None, text: str | None = None, truncated: bool | None = None) -> tuple:
        return path, kind, sheet, name, row, col, gap, cell_type, style, text, truncated

    book = archive.part("xl/workbook.xml")
    yield told("file", text="" if book is not None else NO_PART if archive.ok else NO_ZIP)
    if book is None:
        return
    # strings and styles before the sheets: when the budget runs out, a sheet is lost and not the texts of all
    for k, text in enumerate(shared_strings(archive)):
        yield told("string", col=k, text=text)
    targets = relations(archive, "xl/_rels/workbook.xml.rels")
    in_styles, style, nth = False, 0, 0
    for ev, name, attrs, _ in archive.xml("xl/styles.xml"):
        if name == "cellXfs":
            in_styles = ev == "start"
        elif ev != "end" and name == "xf" and in_styles:
            yield told("style", style=style, col=number(attrs.get("numFmtId")))
            style += 1
        elif ev != "end" and name == "numFmt" and "numFmtId" in attrs and "formatCode" in attrs:
            yield told("format", row=nth, col=number(attrs["numFmtId"]), text=attrs["formatCode"])
            nth += 1
    listed = [a for ev, name, a, _ in book() if ev in ("start", "empty") and name == "sheet" and "name" in a and "id" in a]
    for sheet, attrs in enumerate(listed if max_sheets is None else listed[:max_sheets]):
        target = targets.get(attrs["id"], f"worksheets/sheet{sheet + 1}.xml")
        part = target[1:] if target.startswith("/") else "xl/" + target
        if not archive.holds(part):
            archive.read(part)  # notes it, if it is there
            continue
        for found in sheet_cells(archive, part, max_rows, max_cols):
            if len(found) == 2:
                yield told("sheet", sheet, attrs["name"], row=found[0], truncated=found[1])
            else:
                row, col, gap, cell_type, style, text = found
                yield told("cell", sheet, attrs["name"], row, col, gap, cell_type, style, text)
    for part in archive.refused:
        yield told("refused", text=part)


def read_xlsx(files: DataFrame, max_sheets: int | None = MAX_SHEETS, max_rows: int | None = MAX_ROWS, max_cols: int | None = MAX_COLS, budget: int = BUDGET) -> DataFrame:
    """What the reader finds in ``path, content`` rows: strings, styles, formats, sheets, cells, and parts (``refused``)
    that the budget couldn't hold; a limit of none is off."""
    return expand(files.select("path", "content"), lambda row: xlsx_rows(row["path"], row["content"], max_sheets, max_rows, max_cols, budget), XLSX)


def format_kind(fmt: Column, code: Column) -> Column:
    """What a number format shows: a built-in one by its number, another by its code."""
    return F.when(fmt < 164, builtin_format(fmt)).otherwise(F.coalesce(custom_format(code), F.lit("general")))


def number_formats(styles: DataFrame, codes: DataFrame) -> DataFrame:
    """``path, style, kind`` from ``path, style, fmt`` and ``path, fmt, code, nth``; the first of equal formats counts."""
    return styles.join(first_match(codes, ["path", "fmt"], "code", "nth"), ["path", "fmt"], "left").select("path", "style", format_kind(F.col("fmt"), F.col("code")).alias("kind"))


def with_strings(cells: DataFrame, strings: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``value``: the shared string at a cell's ``idx``, empty beyond the table's ends."""
    return cells.join(strings, [*keys, "idx"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def cells_of(rows: DataFrame) -> DataFrame:
    """``path, sheet_idx, sheet_name, row_idx, col_idx, cell_type, raw, kind, display``: a row per cell, gaps filled.

    Only cells with a style or a shared string take part in the joins.
    """
    of = lambda kind: rows.where(F.col("kind") == kind)
    keys = ["path", "sheet_idx", "sheet_name", "row_idx", "col_idx"]
    formats = number_formats(of("style").select("path", "style", F.col("col_idx").alias("fmt")), of("format").select("path", F.col("col_idx").alias("fmt"), F.col("text").alias("code"), F.col("row_idx").alias("nth")))
    strings = of("string").select("path", F.col("col_idx").alias("idx"), F.col("text").alias("value"))
    cells = of("cell").select(*keys, "gap", "cell_type", "style", F.col("text").alias("raw"))
    is_text = F.col("cell_type") == "s"
    is_styled = (F.col("style") >= 0) & ~is_text
    plain = cells.where(~is_text & ~is_styled).withColumns({"kind": F.lit("general"), "value": F.lit("")})
    styled = cells.where(is_styled).join(formats, ["path", "style"], "left").withColumns({"kind": F.coalesce("kind", F.lit("general")), "value": F.lit("")})
    texts = with_strings(cells.where(is_text).withColumn("idx", leading_number(F.col("raw"), whole=True).cast("int")), strings, ["path"]).drop("idx").withColumn("kind", F.lit("general"))
    every = plain.unionByName(styled).unionByName(texts)
    value = leading_number(F.col("raw"))
    shown = F.when(F.col("kind").isin("date", "datetime", "time"), serial_text(value, F.col("kind"))).when(F.col("kind") == "percent", percent_text(value)).otherwise(F.col("raw"))
    display = F.when(is_text, F.col("value")).when(F.col("cell_type") == "b", F.when(F.col("raw").startswith("1"), "TRUE").otherwise("FALSE")).when((F.col("cell_type") == "") & (F.col("raw") != ""), shown).otherwise(F.col("raw"))
    found = every.select(*keys, "gap", "cell_type", "raw", "kind", display.alias("display"))
    return _filled(found, (F.col("col_idx") - F.col("gap")).cast("int"), keys[:-1]).drop("gap")


def xlsx_cells(files: DataFrame, max_sheets: int | None = MAX_SHEETS, max_rows: int | None = MAX_ROWS, max_cols: int | None = MAX_COLS) -> DataFrame:
    return cells_of(stored(read_xlsx(files, max_sheets, max_rows, max_cols), "xlsx"))


def _filled(cells: DataFrame, first_free: Column, keys: list[str]) -> DataFrame:
    gaps = cells.withColumn("__from", first_free).where(F.col("__from") < F.col("col_idx")).select(*keys, F.explode(F.sequence(F.col("__from"), (F.col("col_idx") - 1).cast("int"))).alias("col_idx"))
    empty = {c: F.lit("") for c in ("cell_type", "raw", "display")} | {"kind": F.lit("general")}
    return cells.unionByName(gaps.withColumns(empty), allowMissingColumns=True)


def fill_gaps(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds an empty cell for each column that a row leaves out before its last one."""
    before = F.coalesce(F.lag("col_idx").over(Window.partitionBy(*keys).orderBy("col_idx")), F.lit(-1))
    return _filled(cells.withColumn("__before", before), (F.col("__before") + 1).cast("int"), keys).drop("__before")
