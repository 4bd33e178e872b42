"""Every file as one row of safe, self-contained HTML.

Each kind has its own branch, which makes ordered pieces; their concatenation per file
is its body. Files that can't be read are rows with an error, never failures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.classify import classify, image_mime
from folio.functions.text import basename, data_uri, directory, escape_html, hex_dump, json_reindent, parent
from folio.operators.delimited import MAX_ROWS, csv_cells
from folio.operators.markdown import md_blocks
from folio.operators.notebook import ipynb_pieces, notebooks
from folio.operators.office import NO_PART, NO_ZIP, docx_html, faults, odf_html, pptx_html, read_docx, read_odf, read_pptx
from folio.operators.pdf import with_pdf_info
from folio.operators.raster import raster_png
from folio.operators.richtext import rtf_pieces
from folio.operators.rows import joined
from folio.operators.spreadsheet import MAX_ROWS as MAX_SHEET_ROWS
from folio.operators.spreadsheet import cells_of, read_xlsx
from folio.sources.corpus import texts
from folio.sources.listing import listing_row
from folio.sources.work import stored

#: Names of wanted images that are sent to all executors, at most; more are joined by shuffle.
BROADCAST_PATHS = 100_000
#: Above, code is shown without the class that asks for highlighting.
MAX_HIGHLIGHT = 400 * 1024
STYLE = "body{font-family:system-ui,sans-serif;margin:0;padding:24px}table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:4px 8px}.errbox{text-align:center;margin-top:15vh}.rownum{color:#888}"
#: The member that each container must have, and what its readers call it.
REQUIRED = {"docx": ("word/document.xml", "word document"), "xlsx": ("xl/workbook.xml", "workbook"), "pptx": ("ppt/slides/slide1.xml", "presentation"), "opendocument": ("content.xml", "open document")}


def page(title: Column, body: Column, offline: bool = False, pdf: Column | None = None) -> Column:
    """A whole page: policy, escaped title, style and body."""
    images = "img-src data:;" if offline else "img-src data: https: http:;"
    plain = "script-src 'unsafe-inline';"
    scripts = plain if pdf is None else F.when(pdf, "script-src 'unsafe-inline' blob:;worker-src blob:;").otherwise(plain)
    policy = F.concat(F.lit(f"default-src 'none';{images}style-src 'unsafe-inline';"), scripts if isinstance(scripts, Column) else F.lit(scripts), F.lit("connect-src 'none';form-action 'none';base-uri 'none';object-src 'none'"))
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="'), policy, F.lit('"><meta name="viewport" content="width=device-width,initial-scale=1"><title>'))
    return F.concat(head, escape_html(title), F.lit(f"</title><style>{STYLE}</style></head><body>"), body, F.lit("</body></html>"))


def error_box(message: Column, detail: Column) -> Column:
    return F.concat(F.lit('<div class="errbox"><div class="icon">&#9888;</div><h2>'), escape_html(message), F.lit('</h2><div class="detail">'), escape_html(F.coalesce(detail, F.lit(""))), F.lit("</div></div>"))


def _code(text: Column, language: Column, size: Column) -> Column:
    css = F.when((size <= MAX_HIGHLIGHT) & language.isNotNull(), F.concat(F.lit(' class="language-'), language, F.lit('"'))).otherwise("")
    return F.concat(F.lit("<pre><code"), css, F.lit(">"), escape_html(text), F.lit("</code></pre>"))


def _whole(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("path").agg(joined("html", "seq").alias("body"))


def csv_body(files: DataFrame) -> DataFrame:
    cells = csv_cells(files)
    tag = F.when(F.col("is_header"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("value")), F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy("path", "row_idx").agg(joined(cell, "col_idx").alias("cells"), F.max("truncated").alias("truncated"))
    head = F.concat(F.lit('<thead><tr><th class="rownum"></th>'), "cells", F.lit("</tr></thead><tbody>"))
    row = F.concat(F.lit('<tr><td class="rownum">'), F.col("row_idx").cast("string"), F.lit("</td>"), "cells", F.lit("</tr>"))
    body = rows.groupBy("path").agg(joined(F.when(F.col("row_idx") == 0, head).otherwise(row), "row_idx").alias("rows"), F.max("truncated").alias("truncated"))
    note = F.when(F.col("truncated"), f'<p class="filehead">Cut off after {MAX_ROWS} rows.</p>').otherwise("")
    made = body.select("path", F.concat(F.lit('<div class="datatable"><table>'), "rows", F.lit("</tbody></table>"), note, F.lit("</div>")).alias("body"))
    return files.select("path").join(made, "path", "left").select("path", F.coalesce("body", F.lit('<div class="datatable"><table></tbody></table></div>')).alias("body"))


def xlsx_body(found: DataFrame) -> DataFrame:
    """Workbooks as tables, from what ``read_xlsx`` found; rows without cells are empty rows."""
    sheets = found.where("kind = 'sheet'").select("path", "sheet_idx", "sheet_name", F.col("row_idx").alias("n_rows"), "truncated")
    rows = cells_of(found).groupBy("path", "sheet_idx", "row_idx").agg(joined(F.concat(F.lit("<td>"), escape_html(F.col("display")), F.lit("</td>")), "col_idx").alias("cells"))
    every = sheets.select("path", "sheet_idx", F.explode(F.when(F.col("n_rows") > 0, F.sequence(F.lit(0), F.col("n_rows") - 1))).alias("row_idx"))
    shown = every.join(rows, ["path", "sheet_idx", "row_idx"], "left").withColumn("cells", F.coalesce("cells", F.lit("")))
    tables = shown.groupBy("path", "sheet_idx").agg(joined(F.concat(F.lit("<tr>"), "cells", F.lit("</tr>")), "row_idx").alias("rows"))
    note = F.when(F.col("truncated"), f'<p class="filehead">Cut off after {MAX_SHEET_ROWS} rows.</p>').otherwise("")
    html = F.concat(F.lit('<h2 class="sheet">'), escape_html(F.col("sheet_name")), F.lit("</h2><table>"), F.coalesce("rows", F.lit("")), F.lit("</table>"), note)
    return _whole(sheets.join(tables, ["path", "sheet_idx"], "left").select("path", F.col("sheet_idx").alias("seq"), html.alias("html")))


def embedded_images(blocks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Images of Markdown blocks that lie in the corpus, put in as data URIs by a join.

    Only files of the corpus are ever looked at. A file that is no image leaves an
    empty span; a reference to a file that isn't there stays as it is.
    """
    refs = blocks.withColumn("src", F.explode_outer(F.regexp_extract_all("html", F.lit('<img src="([^"]*)"'), F.lit(1)))).select("path", "seq", "src").where("src is not null").distinct()
    local = refs.where(~F.col("src").rlike("^(http:|https:|data:|//)"))
    bare = F.regexp_replace("src", "^file://", "")
    target = F.when(bare.startswith("/"), bare).otherwise(F.concat(directory(F.col("path")), bare))
    settled = F.regexp_replace(F.regexp_replace(target, r"/\./", "/"), r"[^/]+/\.\./", "")
    mime = image_mime(F.col("c"), F.lower(F.regexp_extract("src", r"\.([A-Za-z0-9]+)$", 1)))
    is_svg = (mime == "image/svg+xml") & ~F.contains(F.substring("c", 1, 1024), F.lit(b"<svg"))
    wanted = stored(local.withColumn("target", settled), "wanted-images")
    # contents are fetched of files that some text names, and of no others
    names = wanted.select(F.col("target").alias("path")).distinct()
    there = corpus.join(F.broadcast(names) if names.count() <= BROADCAST_PATHS else names, "path", "left_semi")
    found = wanted.join(there.select(F.col("path").alias("target"), F.col("content").alias("c")), "target")
    uris = found.select("path", "seq", "src", F.when((mime != "application/octet-stream") & ~is_svg, data_uri(mime, F.col("c"))).alias("uri"))
    maps = uris.groupBy("path", "seq").agg(F.collect_list(F.struct("src", "uri")).alias("uris"))

    def put(html: Column, x: Column) -> Column:
        at = F.concat(F.lit('<img src="'), x["src"], F.lit('"'))
        with_uri = F.replace(html, at, F.concat(F.lit('<img src="'), x["uri"], F.lit('"')))
        quoted = F.concat(F.lit(r'<img src="\Q'), x["src"], F.lit(r'\E"[^>]*>'))
        return F.when(x["uri"].isNotNull(), with_uri).otherwise(F.regexp_replace(html, quoted, "<span></span>"))

    both = blocks.join(maps, ["path", "seq"], "left")
    return both.withColumn("html", F.when(F.col("uris").isNull(), F.col("html")).otherwise(F.aggregate("uris", F.col("html"), put))).drop("uris")


def render(files: DataFrame, offline: bool = False) -> DataFrame:
    """``path, file_type, html, url, error_message, error_detail`` of ``path, content`` rows, one per file.

    HTML files are not converted: they have a ``url`` and their own text as ``html``.
    """
    # each kind's files lie in a folder of their own, so a branch reads no others
    kinds = stored(classify(files.select("path", "content")), "kinds", by="file_type")
    present = {r.file_type for r in kinds.select("file_type").distinct().collect()}
    of = lambda kind: kinds.where(F.col("file_type") == kind)
    none = F.lit(None).cast("string")
    ok = lambda df: df.select("path", "body", none.alias("message"), none.alias("detail"))
    wrapped = lambda df: df.withColumn("body", F.concat(F.lit('<div class="content">'), "body", F.lit("</div>")))

    def code() -> DataFrame:
        text = F.make_valid_utf8(F.col("content").cast("string"))
        return ok(of("text").select("path", _code(text, F.col("language"), F.length("content")).alias("body")))

    def json() -> DataFrame:
        pretty = texts(of("json")).withColumn("t", json_reindent("text"))
        return ok(pretty.select("path", _code(F.col("t"), F.lit("json"), F.octet_length("t")).alias("body")))

    def image() -> DataFrame:
        uri = data_uri(image_mime(F.col("content"), F.col("ext")), F.col("content"))
        return ok(of("image").select("path", F.concat(F.lit('<img src="'), uri, F.lit('" alt="">')).alias("body")))

    def pdf() -> DataFrame:
        uri = data_uri(F.lit("application/pdf"), F.col("content"))
        note = F.coalesce(F.concat(F.lit('<p class="filehead">'), "note", F.lit("</p>")), F.lit(""))
        told = with_pdf_info(of("pdf"))
        return ok(told.select("path", F.concat(F.lit('<div class="pdf" data-src="'), uri, F.lit('"></div>'), note).alias("body")))

    def binary() -> DataFrame:
        head = F.concat(F.lit("<p>This file can't be shown: "), escape_html(F.col("path")), F.lit(", "), F.length("content").cast("string"), F.lit(" bytes</p><pre>"))
        return ok(of("binary").select("path", F.concat(head, escape_html(hex_dump(F.col("content"))), F.lit("</pre>")).alias("body")))

    def raster() -> DataFrame:
        shown = of("raster").select("path", "ext", raster_png("content").alias("png"))
        body = F.concat(F.lit('<img src="'), data_uri(F.lit("image/png"), F.col("png")), F.lit('" alt="">'))
        bad = F.col("png").isNull()
        return shown.select("path", body.alias("body"), F.when(bad, "This picture can't be decoded").alias("message"), F.when(bad, F.col("ext")).alias("detail"))

    def markdown() -> DataFrame:
        return ok(wrapped(_whole(embedded_images(md_blocks(texts(of("markdown"))), kinds))))

    def notebook() -> DataFrame:
        nb = texts(of("notebook"))
        body = F.concat(F.lit('<div class="nb">'), F.coalesce("body", F.lit("")), F.lit("</div>"))
        return notebooks(nb).join(_whole(ipynb_pieces(nb)), "path", "left").select("path", body.alias("body"), F.col("error_message").alias("message"), F.col("error_detail").alias("detail"))

    def container(kind: str, read: Callable[[DataFrame], DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        part, name = REQUIRED[kind]
        found = stored(read(of(kind)), kind)
        fault = F.when(F.col("fault") == NO_ZIP, "it is no ZIP archive").when(F.col("fault") == NO_PART, f"it has no part {part} within the budget")
        if kind == "xlsx":
            fault = F.coalesce(fault, F.when(F.col("body").isNull(), "none of its sheets can be read"))
        made = faults(found).join(make(found), "path", "left")
        return made.select("path", F.coalesce("body", F.lit("")).alias("body"), F.when(fault.isNotNull(), f"This {name} can't be read").alias("message"), fault.alias("detail"))

    branches = {
        "text": code,
        "json": json,
        "csv": lambda: ok(csv_body(of("csv"))),
        "image": image,
        "pdf": pdf,
        "binary": binary,
        "raster": raster,
        "rtf": lambda: ok(wrapped(_whole(rtf_pieces(of("rtf"))))),
        "markdown": markdown,
        "notebook": notebook,
        "docx": lambda: container("docx", read_docx, lambda found: wrapped(_whole(docx_html(found)))),
        "xlsx": lambda: container("xlsx", read_xlsx, xlsx_body),
        "pptx": lambda: container("pptx", read_pptx, lambda found: _whole(pptx_html(found))),
        "opendocument": lambda: container("opendocument", read_odf, lambda found: wrapped(_whole(odf_html(found)))),
    }
    every = files.sparkSession.createDataFrame([], "path string, body string, message string, detail string")
    for kind, branch in branches.items():
        if kind in present:
            every = every.unionByName(branch())
    both = kinds.select("path", "file_type", F.when(F.col("file_type") == "html", F.col("content").cast("string")).alias("own")).join(every, "path", "left")
    message = F.when(F.col("file_type") != "html", F.coalesce("message", F.when(F.col("body").isNull() & ~F.col("file_type").isin("rtf", "markdown"), "Files of this kind are not converted")))
    body = F.when(message.isNotNull(), error_box(message, F.col("detail"))).otherwise(F.coalesce("body", F.lit("")))
    html = F.when(F.col("file_type") == "html", F.col("own")).otherwise(page(basename(F.col("path")), body, offline, F.col("file_type") == "pdf"))
    url = F.when(F.col("file_type") == "html", F.concat(F.lit("file://"), "path"))
    return both.select("path", "file_type", html.alias("html"), url.alias("url"), message.alias("error_message"), F.col("detail").alias("error_detail"))


def render_listing(entries: DataFrame, offline: bool = False) -> DataFrame:
    """``path, html``: a page per folder of a listing, with a link to the folder above."""
    order = F.struct((~F.col("is_dir")).alias("a"), F.col("name").alias("b"))
    pages = entries.groupBy(F.col("dir").alias("path")).agg(joined(listing_row(), order).alias("rows"))
    up = F.when(parent(F.col("path")).isNotNull(), F.concat(F.lit('<li class="dir" data-path="'), escape_html(parent(F.col("path"))), F.lit('"><span class="name">../</span></li>'))).otherwise("")
    return pages.select("path", page(F.col("path"), F.concat(F.lit('<ul class="listing">'), up, "rows", F.lit("</ul>")), offline).alias("html"))
