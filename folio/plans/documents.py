"""Registered queries over documents with structure, and their DuckDB equivalents.

Each makes files out of whole tables, reads them back with the library's readers, and is
compared with what SQL says must come out.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import classify as K
from folio.functions import text as X
from folio.operators.delimited import csv_cells
from folio.operators.markdown import md_blocks
from folio.operators.notebook import ipynb_cells, ipynb_outputs
from folio.operators.office import TAB, docx_pieces, odf_pieces, pptx_slides
from folio.operators.pdf import pdf_info, read_pages, texts_of
from folio.operators.ranges import large_csv_cells
from folio.operators.rows import joined
from folio.operators.spreadsheet import xlsx_cells
from folio.plans.registry import _quoted, csv_files, query, sql_escape, table
from folio.plans.render import render
from folio.sources.build import PIXEL, packed
from folio.sources.corpus import from_texts
from folio.sources.sink import write_pages
from folio.sources.work import dealt, new_path
from folio.streaming.store import Store
from folio.streaming.watch import current, keep_latest, watch

PIXEL_URI = "data:image/png;base64," + base64.b64encode(PIXEL).decode()


def typed_lines(spark: SparkSession, sf_dir: str, writer: str, kinds: list[str], rest: dict[str, Column] | None = None) -> DataFrame:
    """``path, content``: a document per conversation, with a line per turn, of a kind that follows from its number."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    kind = lambda i: F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.col("conv_id") + i, F.lit(len(kinds))) + 1).cast("int"))

    def line(x: Column, i: Column) -> Column:
        said: Column = x["text"]
        for name, make in (rest or {}).items():
            said = F.when(kind(i) == name, make(x, i)).otherwise(said)  # type: ignore[operator]
        return F.concat(kind(i), F.lit("\t"), said)

    path = F.concat(F.lit("/d/"), F.col("conv_id").cast("string"), F.lit("."), F.lit(writer.rpartition("_")[2]))
    return packed(convs.select(path.alias("path"), F.transform("turns", line).alias("lines")), writer)


def sql_lines(n_kinds: int, ext: str) -> str:
    """A common table ``t``: path, number, kind, escaped text, and whether a line is the last."""
    return f"""WITH t AS (SELECT '/d/' || conv_id || '.{ext}' AS path, row_number() OVER w - 1 AS i, (conv_id + row_number() OVER w - 1) % {n_kinds} AS k,
 role, text, {sql_escape('text')} AS e, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


DOCX_KINDS = ["heading", "0", "1", "bold", "link", "row", "colour", "picture", "deleted", "raised"]
SQL_URL = "CASE WHEN i % 2 = 0 THEN 'https://h.example/?a=1&amp;b=' || i ELSE '#blocked' END"


@query(f"""{sql_lines(10, 'docx')}, h AS (SELECT path, i, CASE k
 WHEN 0 THEN '<h3 style="text-align:justify">' || e || '</h3>'
 WHEN 1 THEN '<ul><li>' || e || '</li>' || CASE WHEN last THEN '</ul>' ELSE '' END
 WHEN 2 THEN CASE WHEN i = 0 THEN '<ol><ol><li>' ELSE '<ol><li>' END || e || '</li>' || CASE WHEN NOT last THEN '' WHEN i = 0 THEN '</ol></ol>' ELSE '</ol></ul>' END
 WHEN 3 THEN CASE i WHEN 0 THEN '' WHEN 1 THEN '</ol></ol>' ELSE '</ol></ul>' END || '<p><b>' || e || '</b></p>'
 WHEN 4 THEN '<p><a href="' || {SQL_URL} || '">' || e || '</a></p>'
 WHEN 5 THEN '<table class="docxtbl"><tr><td><p>' || role || '</p></td><td><p>' || e || '</p></td></tr></table>'
 WHEN 6 THEN '<p><span style="color:#0a0B0c;background:cyan;">' || e || '</span></p>'
 WHEN 7 THEN '<p><img src="{PIXEL_URI}" alt="" style="width:' || (10 + i) || 'px"><span class="missing-img">(picture missing)</span></p>'
 WHEN 8 THEN '<p>' || {sql_escape('substr(text, 1, 3)')} || '<br></p>'
 ELSE '<p><s><sup>' || e || '</sup></s></p>' END AS html FROM t)
SELECT path, md5(string_agg(html, '' ORDER BY i)) AS html_md5 FROM h GROUP BY 1""")
def docx_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word documents with headings, nested lists, runs, links, tables, deletions and pictures."""
    url = lambda i: F.when(i % 2 == 0, F.concat(F.lit("https://h.example/?a=1&b="), i.cast("string"))).otherwise("jav\u0001ascript:x")
    rest = {"link": lambda x, i: F.concat(x["text"], F.lit("\t"), url(i)), "row": lambda x, i: F.concat(x["role"], F.lit("\t"), x["text"]), "picture": lambda x, i: (9525 * (10 + i)).cast("string")}
    files = typed_lines(spark, sf_dir, "rich_docx", DOCX_KINDS, rest)
    return docx_pieces(files).groupBy("path").agg(F.md5(joined("html", "seq")).alias("html_md5"))


ODT_KINDS = ["heading", "bold", "slanted", "note", "0", "row", "picture"]


@query(f"""{sql_lines(7, 'odt')}, h AS (SELECT path, i, CASE k
 WHEN 0 THEN '<h6>' || e || '</h6>' WHEN 1 THEN '<p><span style="font-weight:bold;color:#0a0B0c;">' || e || '</span></p>'
 WHEN 2 THEN '<p><span style="font-style:italic;text-decoration:underline;">' || e || '</span>{TAB}</p>' WHEN 3 THEN '<p>' || e || '</p>'
 WHEN 4 THEN '<ul><li><p>' || e || '</p></li></ul>' WHEN 5 THEN '<table><tr><td colspan="2">' || e || '</td></tr></table>'
 ELSE '<p>' || e || '<img src="{PIXEL_URI}" alt=""></p>' END AS html FROM t)
SELECT path, md5(string_agg(html, '' ORDER BY i)) AS html_md5 FROM h GROUP BY 1""")
def odf_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open documents with own and shared styles, notes, lists, tables and pictures."""
    return odf_pieces(typed_lines(spark, sf_dir, "rich_odt", ODT_KINDS)).groupBy("path").agg(F.md5(joined("html", "seq")).alias("html_md5"))


@query(f"""{sql_lines(1, 'pptx')}
SELECT path, (i + 1)::INTEGER AS slide, {sql_escape('role')} AS title, '<p>' || e || ' </p><img src="{PIXEL_URI}" alt="">' AS body FROM t WHERE i < 3""")
def pptx_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides with titles, paragraphs and pictures, up to a limit of three."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("\t", "role", "text").alias("line")))), lambda x: x["line"])
    decks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("lines"))
    path = F.concat(F.lit("/d/"), F.col("conv_id").cast("string"), F.lit(".pptx"))
    return pptx_slides(packed(decks.select(path.alias("path"), "lines"), "rich_pptx"), max_slides=3)


@query("""
WITH p AS (SELECT '/x/' || (p_partkey // 300) || '.xlsx' AS path, (row_number() OVER (PARTITION BY p_partkey // 300 ORDER BY p_partkey) - 1)::INTEGER AS row_idx, p_name AS t, p_size AS n FROM part),
s AS (SELECT *, (n * 1350) % 86400 AS sec FROM p)
SELECT path, sheet_name, row_idx, col_idx, kind, display FROM s, LATERAL (VALUES
 ('A & B', 0, 'general', t), ('A & B', 1, 'general', ''), ('A & B', 2, 'percent', n || '%'), ('A & B', 3, 'time', printf('%02d:%02d:%02d', sec // 3600, sec // 60 % 60, sec % 60)),
 ('A & B', 4, 'general', n::VARCHAR), ('A & B', 5, 'general', CASE WHEN n % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END), ('C', 0, 'general', ''), ('C', 1, 'general', t)) v(sheet_name, col_idx, kind, display)""")
def xlsx_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of two sheets with custom formats, gaps, flags, cached and inline texts."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws("\t", "p_name", F.col("p_size").cast("string")).alias("line")))), lambda x: x["line"])
    books = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 300).alias("book")).agg(lines.alias("lines"))
    files = packed(books.select(F.concat(F.lit("/x/"), F.col("book").cast("string"), F.lit(".xlsx")).alias("path"), "lines"), "rich_xlsx")
    return xlsx_cells(files).select("path", "sheet_name", F.col("row_idx").cast("int").alias("row_idx"), "col_idx", "kind", "display")


@query("""
WITH d AS (SELECT doc_id, doc_id // 500 AS file, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS row_idx, count(*) OVER (PARTITION BY doc_id // 500) AS n FROM documents)
SELECT '/csv/' || file || '.csv' AS path, row_idx::INTEGER AS row_idx, doc_id::VARCHAR AS value, n + 1 > 150 AS truncated FROM d WHERE row_idx < 150""")
def csv_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files read up to a limit of 150 rows, which some exceed."""
    cells = csv_cells(csv_files(spark, sf_dir), max_rows=150)
    return cells.where("col_idx = 0 and not is_header").select("path", "row_idx", "value", "truncated")


# --- bytes


@query("""
WITH h AS (SELECT doc_id, encode(text) AS b FROM documents), x AS (SELECT doc_id, octet_length(b) AS n, hex(b[1:512]) AS x FROM h),
l AS (SELECT doc_id, n, i, substr(x, i * 32 + 1, 32) AS s FROM x, unnest(range(0, (length(x) + 31) // 32)) u(i)),
p AS (SELECT doc_id, n, i, list_transform(range(0, length(s) // 2), lambda j: substr(s, 2 * j + 1, 2)) AS b FROM l),
q AS (SELECT doc_id, n, i, rpad(lower(list_aggregate(b, 'string_agg', ' ')) || ' ', 48, ' ') AS h, list_aggregate(list_transform(b, lambda c: CASE WHEN c >= '20' AND c < '7F' THEN chr(('0x' || c)::INTEGER) ELSE '.' END), 'string_agg', '') AS a FROM p),
r AS (SELECT doc_id, any_value(n) AS n, string_agg(lpad(lower(hex(i * 16)), 8, '0') || '  ' || h[1:24] || ' ' || h[25:48] || ' |' || a || '|', chr(10) ORDER BY i) AS d FROM q GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(d, '') END || CASE WHEN coalesce(n, 0) > 512 THEN chr(10) || '... (' || (n - 512) || ' more bytes)' ELSE '' END AS dump FROM documents LEFT JOIN r USING (doc_id)""")
def hex_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex dumps of the heads of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", X.hex_dump(F.encode("text", "UTF-8")).alias("dump"))


def _number(n: Column | int, width: int, little: bool = False) -> Column:
    """An unsigned integer as hex digits of so many bytes."""
    digits = F.lpad(F.hex(n if isinstance(n, Column) else F.lit(n)), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in (range(width - 1, -1, -1) if little else range(width))))


@query("""
SELECT p_partkey, p_size::BIGINT AS width, (p_partkey % 50000 + 1)::BIGINT AS height, ['image/png', 'image/gif', 'image/bmp', 'image/jpeg'][(p_partkey % 4)::INTEGER + 1] AS mime,
 ['image/png', 'image/gif', 'application/octet-stream', 'image/jpeg'][(p_partkey % 4)::INTEGER + 1] AS odf_mime FROM part""")
def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and sizes of pictures by their first bytes."""
    w, h = F.col("p_size").cast("long"), F.col("p_partkey") % 50000 + 1
    heads = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _number(w, 4), _number(h, 4)),
        F.concat(F.lit("474946383961"), _number(w, 2, True), _number(h, 2, True)),
        F.concat(F.lit("424D" + "00" * 12 + "28000000"), _number(w, 4, True), F.when(F.col("p_partkey") % 8 < 4, _number(h, 4, True)).otherwise(_number(2**32 - h, 4, True))),
        F.concat(F.lit("FFD8FFE000041234FFC0000B08"), _number(h, 2), _number(w, 2), F.lit("010100")),
    ]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.element_at(F.array(*heads), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("c"))
    size = K.image_size(F.col("c"))
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), K.image_mime(F.col("c"), F.lit("x")).alias("mime"), K.part_mime(F.col("c"), F.lit("x"), "odf").alias("odf_mime"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN p_partkey % 250 + 1 WHEN 4 THEN p_partkey % 10000 + 1 ELSE p_size END::BIGINT AS width, CASE p_partkey % 6 WHEN 3 THEN p_size WHEN 4 THEN p_size WHEN 2 THEN p_partkey % 250 + 1 ELSE p_partkey % 10000 + 1 END::BIGINT AS height FROM part""")
def picture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of WebP, ICO, AVIF and SVG pictures, from chunks, boxes and attributes."""
    w, h = F.col("p_size").cast("long"), F.col("p_partkey") % 10_000 + 1
    low = F.col("p_partkey") % 250 + 1
    hexed = lambda text: F.hex(F.encode(text, "UTF-8"))
    riff = lambda chunk: F.concat(F.lit("524946460000000057454250" + "4A554E4B0100000000" + "00"), chunk)
    ispe = lambda a, b: F.concat(F.lit("0000001469737065" + "00000000"), _number(a, 4), _number(b, 4))
    # ftyp; meta with the primary item 2, properties (two sizes and a turn), and who owns them: item 1 the first, item 2 the others
    avif = F.concat(
        F.lit("0000001066747970" + "6176696600000000" + "000000746D65746100000000" + "0000000E7069746D000000000002" + "0000005A69707270" + "000000396970636F"), ispe(F.lit(9), F.lit(9)), ispe(w, h),
        F.lit("0000000969726F7401" + "0000001969706D61" + "0000000000000002" + "00010101" + "0002020203"),
    )
    bits = (w - 1) + (h - 1) * 2**14
    heads = [
        riff(F.concat(F.lit("565038580A000000" + "00000000"), _number(w - 1, 3, True), _number(h - 1, 3, True))),
        riff(F.concat(F.lit("5650384C050000002F"), _number(bits, 4, True))),
        F.concat(F.lit("000001000200" + "01010000" + "00" * 12), _number(w, 1), _number(low, 1), F.lit("0000" + "00" * 12)),
        hexed(F.concat(F.lit("<?xml?><!-- <svg width='1' height='1'> --><svg a='>' viewBox='0 0 "), low.cast("string"), F.lit(" "), w.cast("string"), F.lit("' width='"), low.cast("string"), F.lit("px'>"))),
        avif,
        riff(F.concat(F.lit("565038200A000000" + "0000009D012A"), _number(w, 2, True), _number(h, 2, True))),
    ]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.element_at(F.array(*heads), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("c"))
    size = K.image_size(F.col("c"))
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("""
WITH p AS (SELECT doc_id, doc_id % 230 AS n FROM documents)
SELECT '/p/' || doc_id || '.pdf' AS path, '1.' || (doc_id % 8) AS version, n::INTEGER AS n_pages, doc_id % 3 = 0 AS encrypted,
       CASE WHEN n > 200 THEN n || ' pages, the first 200 of them shown' WHEN n = 1 THEN '1 page' WHEN n > 0 THEN n || ' pages' END AS note FROM p""")
def pdf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What PDF files tell of themselves: version, pages, encryption."""
    text = F.concat(F.lit("%PDF-1."), (F.col("doc_id") % 8).cast("string"), F.lit("\n<< /Type /Pages >>\n"), F.repeat(F.lit("<< /Type /Page >>\n"), (F.col("doc_id") % 230).cast("int")), F.when(F.col("doc_id") % 3 == 0, "<< /Encrypt 4 0 R >>").otherwise(""))
    files = from_texts(table(spark, sf_dir, "documents"), F.concat(F.lit("/p/"), F.col("doc_id").cast("string"), F.lit(".pdf")), text)
    return pdf_info(files).select("path", "version", "n_pages", "encrypted", "note")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
w AS (SELECT doc_id, page, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l)
SELECT '/t/' || doc_id || '.pdf' AS path, page::INTEGER AS page, CASE WHEN page % 2 = 1 THEN 500 + (page - 1) % 100 ELSE 600 END::DOUBLE AS width, CASE WHEN page % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_links,
       array_to_string([array_to_string(list_slice(ws, k * 12 + 1, k * 12 + 12), ' ') for k in range((len(ws) + 11) // 12)], chr(10)) AS text FROM w""")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as PDFs, a page per line, and read back: sizes, links and text of every page."""
    docs = dealt(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    files = packed(docs.select(F.concat(F.lit("/t/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.split("text", "\n", -1).alias("lines")), "pdf")
    return texts_of(read_pages(files)).select("path", "page", "width", "n_links", "text")


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents")
def csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as large CSV files, whose ranges are read by tasks of their own, quoted line ends and all."""
    folder = new_path(spark, "csv")
    table(spark, sf_dir, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), _quoted("lang"), _quoted("text"))).write.text(folder)
    cells = large_csv_cells(spark, folder, ",")
    cell = lambda k: F.max(F.when(F.col("col_idx") == k, F.col("value")))
    return cells.groupBy("path", "row_idx").agg(cell(0).alias("doc_id"), cell(1).alias("lang"), cell(2).alias("text")).drop("path", "row_idx")


@query("SELECT 'p/' || page_id || '.html' AS name, md5(coalesce(html, '')) AS md5 FROM pages")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a file each, all or none, and read back."""
    folder = new_path(spark, "pages")
    write_pages(table(spark, sf_dir, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("path"), "html"), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", "(p/[^/]*)$", 1).alias("name"), F.md5("content").alias("md5"))


@query("SELECT 'p/' || page_id || '.html' AS name, md5(coalesce(html, '')) AS md5 FROM pages")
def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of pages, watched until all are in the table of current files."""
    folder, store, checkpoint = (new_path(spark, n) for n in ("watched", "current", "offsets"))
    write_pages(table(spark, sf_dir, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("path"), "html"), folder)
    keep_latest(watch(spark, folder, "*.html"), store, checkpoint, max_files=None).trigger(availableNow=True).start().awaitTermination()
    return current(spark, store).select(F.regexp_extract("path", "(p/[^/]*)$", 1).alias("name"), F.md5("content").alias("md5"))


@query("""
WITH b AS (SELECT user_id, event_id % 5 AS batch, max(event_id) AS event_id FROM events GROUP BY ALL), l AS (SELECT user_id, max(batch) AS batch FROM b GROUP BY 1)
SELECT user_id::VARCHAR AS path, event_id, batch FROM b JOIN l USING (user_id, batch) WHERE event_id % 7 <> 0""")
def watch_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each path over batches that are merged in generations, with deletions."""
    store = Store(spark, new_path(spark, "store"), fan=2)
    events = table(spark, sf_dir, "events")
    for batch in range(5):
        rows = events.where(F.col("event_id") % 5 == batch).groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("event_id").alias("event_id"))
        store.append(batch, rows.withColumn("deleted", F.col("event_id") % 7 == 0))
    return store.current().select("path", "event_id", "batch")


# --- paths and numbers


@query("""
WITH u AS (SELECT DISTINCT url AS p FROM pages UNION SELECT unnest(['/', '/a', '/a/', '/a/b', '/a/b///', 'a', 'a/b'])), b AS (SELECT p, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END AS b FROM u)
SELECT p AS path, CASE WHEN b = '/' OR instr(b, '/') = 0 THEN NULL ELSE CASE regexp_extract(b, '^(.*)/[^/]*$', 1) WHEN '' THEN '/' ELSE regexp_extract(b, '^(.*)/[^/]*$', 1) END END AS parent,
       CASE WHEN p LIKE '%/' THEN p || 'x' ELSE p || '/x' END AS child FROM b""")
def paths_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder above a path, and a name joined to it."""
    more = spark.createDataFrame([(p,) for p in ("/", "/a", "/a/", "/a/b", "/a/b///", "a", "a/b")], "path string")
    paths = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).union(more).distinct()
    return paths.select("path", X.parent(F.col("path")).alias("parent"), X.join_path(F.col("path"), F.lit("x")).alias("child"))


@query("""
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice::VARCHAR WHEN 1 THEN ' ' || (o_orderkey % 1000) || 'x7' WHEN 2 THEN '-' || o_orderkey || '.' ELSE o_orderpriority END AS raw FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN raw::DOUBLE WHEN 1 THEN (o_orderkey % 1000)::DOUBLE WHEN 2 THEN -o_orderkey::DOUBLE ELSE left(raw, 1)::DOUBLE END AS number, (o_orderkey % 100) || '%' AS percent FROM o""")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that texts begin with, and percentages."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.col("o_totalprice").cast("string")).when(k % 4 == 1, F.concat(F.lit(" "), (k % 1000).cast("string"), F.lit("x7"))).when(k % 4 == 2, F.concat(F.lit("-"), k.cast("string"), F.lit("."))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.leading_number(raw).alias("number"), X.percent_text((k % 100) / 100).alias("percent"))


# --- notebooks, Markdown and errors

OUTPUTS = [
    '{"output_type":"stream","name":"stderr","text":[%s,"!"]}', '{"output_type":"execute_result","data":{"text/html":"<i>","text/plain":%s}}', '{"output_type":"error","traceback":[%s,"\\u001b[31mat\\u001b[0m"]}',
    '{"output_type":"display_data","data":{"image/png":"iV BO\\nR"}}', '{"output_type":"other"}',
]


@query("""
WITH t AS (SELECT '/n/' || conv_id || '.ipynb' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS cell, text, role, conv_id FROM conversations),
s AS (SELECT *, (conv_id + cell) % 5 AS k FROM t)
SELECT path, cell, CASE k WHEN 0 THEN 'stderr' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'error' ELSE 'image/png' END AS kind,
       CASE k WHEN 0 THEN text || '!' WHEN 1 THEN text WHEN 2 THEN text || chr(10) || 'at' || chr(10) ELSE 'iVBOR' END AS text,
       CASE conv_id % 3 WHEN 0 THEN 'julia' WHEN 1 THEN 'r' ELSE 'python' END AS language FROM s WHERE k < 4""")
def ipynb_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of notebooks of all kinds, and their language."""
    one = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    k = F.pmod(F.col("conv_id") + F.col("place"), F.lit(5))
    output = F.coalesce(*(F.when(k == i, F.replace(F.lit(o), F.lit("%s"), one)) for i, o in enumerate(OUTPUTS)))
    cell = F.concat(F.lit('{"cell_type":"code","source":[],"outputs":['), output, F.lit("]}"))
    cells = table(spark, sf_dir, "conversations").withColumn("place", place).groupBy("conv_id").agg(joined(cell, "turn", ",").alias("cells"))
    about = F.when(F.col("conv_id") % 3 == 0, '{"language_info":{"name":"julia"},"kernelspec":{"language":"c"}}').when(F.col("conv_id") % 3 == 1, '{"language_info":{"name":""},"kernelspec":{"language":"r"}}').otherwise('{"kernelspec":{}}')
    nb = cells.select(F.concat(F.lit("/n/"), F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), F.concat(F.lit('{"metadata":'), about, F.lit(',"cells":['), "cells", F.lit("]}")).alias("text"))
    found = ipynb_cells(nb)
    return ipynb_outputs(found).join(found.select("path", "cell", "language"), ["path", "cell"]).select("path", "cell", "kind", "text", "language")


@query(f"""
WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_acctbal::VARCHAR AS b FROM supplier)
SELECT '/m/' || k || '.md' AS path, seq::INTEGER AS seq, kind, html FROM s, LATERAL (VALUES
 (0, 'h2', '<h2>' || {sql_escape('n')} || ' <em>co</em></h2>' || chr(10)),
 (1, 'p', '<p>has <strong>' || b || '</strong> and <code>' || k || '_*x*</code><br>' || chr(10) || '<a href="https://s.example/' || k || '" title="t">see</a> <a href="#blocked">not</a></p>' || chr(10)),
 (2, 'ul', '<ul>' || chr(10) || '<li class="task-list-item"><input type="checkbox" class="task-list-item-checkbox" disabled checked>paid</li>' || chr(10) || '<li>open<ol>' || chr(10) || '<li>deep</li>' || chr(10) || '</ol>' || chr(10) || '</li>' || chr(10) || '</ul>' || chr(10)),
 (3, 'table', '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>a</th><th align="right">b</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td>' || k || '</td><td align="right"><del>' || b || '</del></td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10)),
 (4, 'code', '<pre><code class="language-sql">select &#39;' || {sql_escape('n')} || '&#39; &lt; 3' || chr(10) || '</code></pre>' || chr(10)),
 (5, 'quote', '<blockquote>' || chr(10) || '<p>said ' || {sql_escape('n')} || '</p>' || chr(10) || '</blockquote>' || chr(10)),
 (6, 'hr', '<hr>' || chr(10))) v(seq, kind, html)""")
def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with every kind of block and span, a file per supplier."""
    name, balance, key = F.col("s_name"), F.col("s_acctbal").cast("string"), F.col("s_suppkey").cast("string")
    lines = [
        F.concat(F.lit("## "), name, F.lit(" *co* ##")), F.lit(""),
        F.concat(F.lit("has **"), balance, F.lit("** and `"), key, F.lit("_*x*`  ")), F.concat(F.lit("[see](https://s.example/"), key, F.lit(' "t") [not](javascript:x)')), F.lit(""),
        F.lit("- [x] paid"), F.lit("- open"), F.lit("  1. deep"), F.lit(""),
        F.lit("a | b"), F.lit("--- | --:"), F.concat(key, F.lit(" | ~~"), balance, F.lit("~~")), F.lit(""),
        F.lit("```sql"), F.concat(F.lit("select '"), name, F.lit("' < 3")), F.lit("```"),
        F.concat(F.lit("> said "), name), F.lit(""), F.lit("***"),
    ]
    texts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/m/"), key, F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("text"))
    return md_blocks(texts)


@query(f"""
SELECT '/m/' || s_suppkey || '.md' AS path, 0 AS seq, '<p>see <a href="https://s.example/' || s_suppkey || '" title="' || {sql_escape('s_name')} || '">' || {sql_escape('s_name')} || '</a>, <a href="https://s.example/' || s_suppkey || '" title="' || {sql_escape('s_name')} || '">k</a><sup class="footnote-ref"><a href="#fn-1" id="fnref-1">1</a></sup></p>' || chr(10) AS html FROM supplier
UNION ALL SELECT '/m/' || s_suppkey || '.md', 1, '<section class="footnotes">' || chr(10) || '<ol>' || chr(10) || '<li id="fn-1">balance <em>' || s_acctbal::VARCHAR || '</em> <a href="#fnref-1" class="footnote-backref">\u21a9</a></li>' || chr(10) || '</ol>' || chr(10) || '</section>' || chr(10) FROM supplier""")
def markdown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and footnotes of Markdown whose definitions come after their use."""
    name, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("see ["), name, F.lit("][K], [k][][^n]\n\n[k]: https://s.example/"), key, F.lit(' "'), name, F.lit('"\n[^n]: balance *'), F.col("s_acctbal").cast("string"), F.lit("*\n"))
    return md_blocks(table(spark, sf_dir, "supplier").select(F.concat(F.lit("/m/"), key, F.lit(".md")).alias("path"), text.alias("text"))).select("path", "seq", "html")


@query(f"""
SELECT '/m/' || s_suppkey || '.md' AS path, ['{PIXEL_URI}', 'img/none.png', NULL][(s_suppkey % 3)::INTEGER + 1] AS src FROM supplier""")
def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of Markdown files from the same corpus; a file that is no picture leaves none."""
    target = F.when(F.col("s_suppkey") % 3 == 0, "./img/../img/p.png").when(F.col("s_suppkey") % 3 == 1, "img/none.png").otherwise("/m/secret.txt")
    texts = from_texts(table(spark, sf_dir, "supplier"), F.concat(F.lit("/m/"), F.col("s_suppkey").cast("string"), F.lit(".md")), F.concat(F.lit("![p]("), target, F.lit(")")))
    more = spark.createDataFrame([("/m/img/p.png", PIXEL), ("/m/secret.txt", b"hidden")], "path string, content binary")
    pages = render(texts.unionByName(more)).where("file_type = 'markdown'")
    return pages.select("path", F.nullif(F.regexp_extract("html", '<img src="([^"]*)"', 1), F.lit("")).alias("src"))


BROKEN = ["docx", "xlsx", "pptx", "odt", "ipynb", "psd"]


@query(f"""
SELECT '/b/' || doc_id || '.' || {BROKEN}[(doc_id % 6)::INTEGER + 1] AS path, ['This word document', 'This workbook', 'This presentation', 'This open document', 'This notebook', 'This picture'][(doc_id % 6)::INTEGER + 1]
       || CASE WHEN doc_id % 6 = 5 THEN ' can''t be decoded' ELSE ' can''t be read' END AS error_message, CASE doc_id % 6 WHEN 4 THEN 'it is no JSON' WHEN 5 THEN 'psd' ELSE 'it is no ZIP archive' END AS error_detail FROM documents""")
def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that claim to be files of other kinds become rows with an error."""
    ext = F.element_at(F.array(*map(F.lit, BROKEN)), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    files = from_texts(docs, F.concat(F.lit("/b/"), F.col("doc_id").cast("string"), F.lit("."), ext), F.concat(F.lit("no "), F.coalesce("text", F.lit(""))))
    return render(files).select("path", "error_message", "error_detail")
