"""Word documents, slides and open documents as ordered pieces of HTML.

A reader goes once over a document's XML and tells what it finds, with the variables that it
carries along (run formatting, paragraph properties, "inside a deletion"): a row per run,
paragraph, cell or picture. Everything else is DataFrame work: escaping and tags are
expressions, list tags are windows over the list items of a document, and pictures come by a
join that only rows with a picture take part in. The rows are ``path, seq, kind, html``
pieces in order, whose concatenation is the body.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.classify import part_mime
from folio.functions.text import data_uri, escape_html, safe_link
from folio.operators.containers import Container, Event, relations
from folio.operators.rows import expand, joined
from folio.sources.work import stored

TAB = '<span style="display:inline-block;width:2em"></span>'
MAX_SLIDES = 200
MAX_DEPTH = 16
#: What every reader says of a file first: nothing, or why it can't be read.
NO_ZIP, NO_PART = "zip", "part"


def number(text: str | None, default: int = 0) -> int:
    """The whole number that a text begins with, as a 32-bit integer."""
    m = re.match(r"\s*([+-]?[0-9]{1,18})", text or "")
    return max(-(2**31), min(2**31 - 1, int(m[1]))) if m else default


def is_on(attrs: dict[str, str]) -> bool:
    """A toggle's value: on, unless it says otherwise."""
    return attrs.get("val") not in ("false", "0", "none")


def faults(rows: DataFrame) -> DataFrame:
    """``path, fault`` for every file: why it can't be read, or null."""
    return rows.where("kind = 'file'").select("path", F.nullif("text", F.lit("")).alias("fault"))


def with_images(rows: DataFrame, dialect: str) -> DataFrame:
    """Rows with ``uri`` and ``known`` where they name an ``image`` part; the other rows meet no join."""
    mime = part_mime(F.col("content"), F.col("image"), dialect)
    found = rows.where("kind = 'image'").select("path", "image", F.when(mime.isNotNull(), data_uri(mime, F.col("content"))).alias("uri"), F.lit(True).alias("known"))
    pieces = rows.where("kind not in ('image', 'file')").drop("content")
    shown = pieces.where("image is not null").join(found, ["path", "image"], "left")
    plain = pieces.where("image is null").withColumns({"uri": F.lit(None).cast("string"), "known": F.lit(None).cast("boolean")})
    return plain.unionByName(shown)


def list_tags(events: DataFrame) -> DataFrame:
    """``path, seq, tags``: the list tags before each event.

    ``want`` is the depth that an event needs; going deeper opens lists of its type, and
    another type at the same depth closes one list and opens the next. At each depth
    d, events with a smaller ``want`` end a list. Since the last of them, its type is that of the
    last event that wanted just d, else that of the first event.
    """
    deepest = F.max("want").over(Window.partitionBy("path"))
    levels = events.withColumn("deepest", deepest).withColumn("d", F.explode(F.when(F.col("deepest") > 0, F.sequence(F.lit(1), F.col("deepest")))))
    w = Window.partitionBy("path", "d").orderBy("seq")
    inside = F.col("want") >= F.col("d")
    islands = levels.withColumn("island", F.sum(F.when(inside, 0).otherwise(1)).over(w))
    here = Window.partitionBy("path", "d", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    exact = F.last(F.when(F.col("want") == F.col("d"), F.col("is_ul")), ignorenulls=True).over(here)
    first = F.first(F.when(inside, F.col("is_ul")), ignorenulls=True).over(here)
    typed = islands.withColumn("now", F.when(inside, F.coalesce(exact, first))).withColumn("was", F.lag("now").over(w))
    tag = lambda c, slash: F.concat(F.lit(f"<{slash}"), F.when(F.col(c), "ul").otherwise("ol"), F.lit(">"))
    changed = ~F.col("was").eqNullSafe(F.col("now"))
    told = typed.withColumns({"closes": F.when(changed & F.col("was").isNotNull(), tag("was", "/")), "opens": F.when(changed & F.col("now").isNotNull(), tag("now", ""))})
    in_order = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(by.alias("o"), F.col(c).alias("v"))))), lambda p: p["v"]), "")
    tags = told.groupBy("path", "seq").agg(F.concat(in_order("closes", -F.col("d")), in_order("opens", F.col("d"))).alias("tags"))
    return tags.unionByName(events.withColumn("deepest", deepest).where("deepest = 0").select("path", "seq", F.lit("").alias("tags")))


# --- word documents

DOCX = (
    "path string, seq int, kind string, text string, image string, content binary, bold boolean, italic boolean, underline boolean, strike boolean,"
    "vert string, color string, mark string, align string, want int, is_ul boolean, size long"
)
RUN = {"bold": False, "italic": False, "underline": False, "strike": False, "vert": "", "color": "", "mark": ""}
TOGGLES = {"w:b": "bold", "w:i": "italic", "w:u": "underline", "w:strike": "strike"}


def bullets(archive: Container) -> dict[int, dict[int, bool]]:
    """For each list of the numbering part whether its levels are bullets; levels that it leaves out are numbered."""
    kinds: dict[int, dict[int, bool]] = {}
    lists: dict[int, int] = {}
    abstract = level = own = None
    for ev, name, attrs, _ in archive.xml("word/numbering.xml"):
        if ev not in ("start", "empty"):
            continue
        if name == "w:abstractNum" and "abstractNumId" in attrs:
            abstract = number(attrs["abstractNumId"])
            kinds.setdefault(abstract, {})
        elif name == "w:lvl":
            level = number(attrs.get("ilvl"), -1)
        elif name == "w:numFmt" and abstract is not None and "val" in attrs:
            kinds[abstract][level] = attrs["val"] == "bullet"
        elif name == "w:num" and "numId" in attrs:
            own = number(attrs["numId"])
        elif name == "w:abstractNumId" and own is not None:
            lists.setdefault(own, number(attrs.get("val")))
    return {n: kinds[a] for n, a in lists.items() if a in kinds}


def docx_rows(path: str, content: bytes | None) -> Iterator[tuple]:
    archive = Container(content)
    body = archive.part("word/document.xml")
    yield _docx(path, 0, "file", "" if body is not None else NO_PART if archive.ok else NO_ZIP)
    if body is None:
        return
    targets, lists, wanted = relations(archive, "word/_rels/document.xml.rels"), bullets(archive), {}
    on: set[str] = set()  # the elements of interest that are open
    run, style, has_list = dict(RUN), {}, False
    done: list[list] = []
    held: list[list] = []  # runs of a paragraph whose kind is not known yet
    cell: list | None = None
    embed, width = "", 0
    for ev, name, attrs, text in body():
        opens = ev in ("start", "empty")
        if name in ("w:pPr", "w:rPr", "w:del", "w:t", "w:instrText", "w:tcPr", "w:drawing") and (ev != "empty" or name == "w:t"):
            (on.add if ev == "start" else on.discard)(name)
        if opens and name == "w:p":
            style, held = {"heading": 0, "align": "", "list": -1, "level": 0}, []
        elif ev == "start" and name == "w:r":
            run = dict(RUN)
        elif opens and "w:pPr" in on and name in ("w:pStyle", "w:jc", "w:numId", "w:ilvl"):
            value = attrs.get("val")
            if name == "w:pStyle" and value is not None:
                low = value.lower()
                style["heading"] = 1 if low == "title" else number(low[7:]) if low.startswith("heading") and len(low) > 7 else style.get("heading", 0)
            elif value is not None:
                style[{"w:jc": "align", "w:numId": "list", "w:ilvl": "level"}[name]] = value if name == "w:jc" else number(value)
        elif opens and "w:rPr" in on and name in TOGGLES:
            run[TOGGLES[name]] = is_on(attrs)
        elif opens and "w:rPr" in on and name in ("w:vertAlign", "w:color", "w:highlight"):
            value = attrs.get("val", "")
            if name == "w:vertAlign":
                run["vert"] = value
            elif name == "w:color":
                run["color"] = value if re.fullmatch("[0-9A-Fa-f]{6}", value) else ""
            else:
                run["mark"] = value[:23] if re.fullmatch("[a-z]+", value) and value != "none" else ""
        if ev == "start" and name == "w:drawing":
            embed, width = "", 0
        elif opens and "w:drawing" in on and name == "a:blip":
            embed = attrs.get("embed", embed)
        elif opens and "w:drawing" in on and name == "wp:extent":
            width = number(attrs.get("cx"))
        elif opens and "w:tcPr" in on and name == "w:gridSpan" and cell is not None:
            cell[-1] = max(cell[-1] or 0, number(attrs.get("val")))

        deleted = "w:del" in on
        if ev == "text":
            if "w:t" in on and not deleted and "w:instrText" not in on:
                held.append(_row("run", text, run=run))
        elif opens and name in ("w:br", "w:cr") and not deleted and "w:rPr" not in on:
            held.append(_row("br"))
        elif opens and name == "w:tab" and not deleted and not on & {"w:pPr", "w:rPr"}:
            held.append(_row("tab"))
        elif ev == "start" and name == "w:hyperlink":
            target = targets.get(attrs.get("id"))
            held.append(_row("link", target if target is not None else "#" + attrs["anchor"] if "anchor" in attrs else None))
        elif ev == "end" and name == "w:hyperlink":
            held.append(_row("unlink"))
        elif ev == "end" and name == "w:drawing" and not deleted and embed in targets:
            place = targets[embed][1:] if targets[embed].startswith("/") else "word/" + targets[embed]
            wanted.setdefault(place)
            held.append(_row("picture", image=place, size=width))
        elif ev == "end" and name == "w:p" and style:
            is_item = style["list"] >= 0
            has_list |= is_item
            kind = "item" if is_item else f"h{min(style['heading'], 6)}" if style["heading"] > 0 else "p"
            level = style["level"] if 0 <= style["level"] <= 8 else 0
            is_ul = lists[style["list"]].get(level, False) if style["list"] in lists else True
            done += [_row(kind, align=style["align"], want=max(0, min(style["level"] + 1, MAX_DEPTH)) if is_item else 0, is_ul=is_ul), *held, _row("end", kind)]
            held = []
        elif name in ("w:tbl", "w:tr", "w:tc") and ev in ("start", "end"):
            ends_lists = (name == "w:tbl" and ev == "start") or (name == "w:tc" and ev == "end")
            done.append(_row(name[2:] if ev == "start" else "/" + name[2:], want=0 if ends_lists else None))
            cell = done[-1] if name == "w:tc" and ev == "start" else cell
        elif ev == "end" and name == "w:body":
            done.append(_row("/body", want=0))
    for seq, row in enumerate(done):
        kind, text, image, run, align, want, is_ul, size = row
        yield path, seq, kind, text, image, None, *run.values(), align, want if has_list else None, is_ul, size
    for place in wanted:
        if (data := archive.read(place)) is not None:
            yield _docx(path, 0, "image", None, place, data)


def _row(kind: str, text: str | None = None, image: str | None = None, run: dict = RUN, align: str = "", want: int | None = None, is_ul: bool = True, size: int | None = None) -> list:
    return [kind, text, image, run, align, want, is_ul, size]


def _docx(path: str, seq: int, kind: str, text: str | None, image: str | None = None, content: bytes | None = None) -> tuple:
    return path, seq, kind, text, image, content, *RUN.values(), "", None, True, None


def read_docx(files: DataFrame) -> DataFrame:
    """What the reader finds in ``path, content`` rows."""
    return expand(files.select("path", "content"), lambda row: docx_rows(row["path"], row["content"]), DOCX)


def _styled(text: Column) -> Column:
    """A run's text in its tags."""
    css = F.concat(F.when(F.col("color") != "", F.concat(F.lit("color:#"), "color", F.lit(";"))).otherwise(""), F.when(F.col("mark") != "", F.concat(F.lit("background:"), "mark", F.lit(";"))).otherwise(""))
    tags = (("b", F.col("bold")), ("i", F.col("italic")), ("u", F.col("underline")), ("s", F.col("strike")), ("sup", F.col("vert") == "superscript"), ("sub", F.col("vert") == "subscript"))
    opening = [F.when(on, f"<{tag}>").otherwise("") for tag, on in tags]
    closing = [F.when(on, f"</{tag}>").otherwise("") for tag, on in reversed(tags)]
    span = F.when(css != "", F.concat(F.lit('<span style="'), css, F.lit('">'))).otherwise("")
    return F.concat(span, *opening, text, *closing, F.when(css != "", "</span>").otherwise(""))


def docx_html(rows: DataFrame) -> DataFrame:
    """Paragraphs, runs, list tags and tables of word documents, in order."""
    events = rows.where("want is not null").select("path", "seq", "want", "is_ul")
    looked = with_images(rows.where("want is null"), "docx").withColumn("tags", F.lit(""))
    listed = rows.where("want is not null").drop("content").withColumns({"uri": F.lit(None).cast("string"), "known": F.lit(None).cast("boolean")})
    every = looked.unionByName(listed.join(list_tags(events), ["path", "seq"]))
    kind, text = F.col("kind"), F.col("text")
    pixels = F.floor(F.col("size") / 9525)
    width = F.when((pixels > 0) & (pixels < 4000), F.concat(F.lit(' style="width:'), pixels.cast("string"), F.lit('px"'))).otherwise("")
    picture = F.when(F.col("uri").isNotNull(), F.concat(F.lit('<img src="'), "uri", F.lit('" alt=""'), width, F.lit(">"))).when(F.col("known"), '<span class="missing-img">(picture of another kind)</span>').otherwise('<span class="missing-img">(picture missing)</span>')
    href = F.when(text.isNotNull() & safe_link(text), escape_html(text)).otherwise("#blocked")
    align = F.when(F.col("align").isin("center", "right"), F.col("align")).when(F.col("align") == "both", "justify")
    style = F.when(align.isNotNull(), F.concat(F.lit(' style="text-align:'), align, F.lit('"'))).otherwise("")
    span = F.when(F.col("size") > 1, F.concat(F.lit(' colspan="'), F.col("size").cast("string"), F.lit('"'))).otherwise("")
    html = (
        F.when(kind == "run", _styled(escape_html(text)))
        .when(kind.rlike("^(p|h[1-6])$"), F.concat(F.lit("<"), kind, style, F.lit(">")))
        .when(kind == "item", "<li>")
        .when(kind == "end", F.when(text == "item", "</li>").otherwise(F.concat(F.lit("</"), text, F.lit(">"))))
        .when(kind == "br", "<br>")
        .when(kind == "tab", TAB)
        .when(kind == "link", F.concat(F.lit('<a href="'), href, F.lit('">')))
        .when(kind == "unlink", "</a>")
        .when(kind == "picture", picture)
        .when(kind == "tbl", '<table class="docxtbl">')
        .when(kind == "tr", "<tr>")
        .when(kind == "tc", F.concat(F.lit("<td"), span, F.lit(">")))
        .when(kind == "/tc", "</td>")
        .when(kind == "/tr", "</tr>")
        .when(kind == "/tbl", "</table>")
        .otherwise("")
    )
    return every.select("path", "seq", "kind", F.concat("tags", html).alias("html"))


def docx_pieces(files: DataFrame) -> DataFrame:
    return docx_html(stored(read_docx(files), "docx"))


# --- slides

PPTX = "path string, slide int, seq int, kind string, text string, image string, content binary"


def pptx_rows(path: str, content: bytes | None, max_slides: int | None) -> Iterator[tuple]:
    """Slides 1, 2, ... up to the first number that is missing: a row for each, its paragraphs and its pictures."""
    archive = Container(content)
    images: dict[str, None] = {}
    n, seq = 0, 0
    while max_slides is None or n < max_slides:
        slide = archive.part(f"ppt/slides/slide{n + 1}.xml")
        if slide is None:
            break
        n, has_title, is_title, said = n + 1, False, False, None
        on: set[str] = set()
        yield path, n, seq, "slide", None, None, None
        targets = relations(archive, f"ppt/slides/_rels/slide{n}.xml.rels")
        for ev, name, attrs, text in slide():
            opens = ev in ("start", "empty")
            seq += 1
            if name == "p:sp":
                is_title = False
                (on.add if opens else on.discard)(name)
            elif name == "a:t":
                (on.add if ev == "start" else on.discard)(name)
            elif opens and name == "p:ph" and "p:sp" in on and attrs.get("type") in ("title", "ctrTitle"):
                is_title = True
            elif name == "a:p":
                if ev == "end" and said:
                    first = is_title and not has_title
                    has_title |= first
                    yield path, n, seq, "title" if first else "p", "".join(said), None, None
                said = [] if ev == "start" else None
            elif opens and name == "a:blip" and (target := targets.get(attrs.get("embed"))) is not None:
                place = target[1:] if target.startswith("/") else "ppt/" + target[3:] if target.startswith("../") else "ppt/slides/" + target
                images.setdefault(place)
                yield path, n, seq, "picture", None, place, None
            elif said is not None:
                if ev == "text" and "a:t" in on:
                    said.append(text)
                elif opens and name == "a:br":
                    said.append(" ")
    yield path, 0, 0, "file", "" if n else NO_PART if archive.ok else NO_ZIP, None, None
    for place in images:
        if (data := archive.read(place)) is not None:
            yield path, 0, 0, "image", None, place, data


def read_pptx(files: DataFrame, max_slides: int | None = MAX_SLIDES) -> DataFrame:
    """What the reader finds in ``path, content`` rows; at most ``max_slides`` of a file, all if that is none."""
    return expand(files.select("path", "content"), lambda row: pptx_rows(row["path"], row["content"], max_slides), PPTX)


def slides_of(rows: DataFrame) -> DataFrame:
    """``path, slide, title, body``, as HTML."""
    html = F.when(F.col("kind") == "p", F.concat(F.lit("<p>"), escape_html(F.col("text")), F.lit("</p>"))).when((F.col("kind") == "picture") & F.col("uri").isNotNull(), F.concat(F.lit('<img src="'), "uri", F.lit('" alt="">'))).otherwise("")
    title = F.max(F.when(F.col("kind") == "title", escape_html(F.col("text"))))
    return with_images(rows, "pptx").withColumn("html", html).groupBy("path", "slide").agg(F.coalesce(title, F.lit("")).alias("title"), joined("html", "seq").alias("body"))


def pptx_slides(files: DataFrame, max_slides: int | None = MAX_SLIDES) -> DataFrame:
    return slides_of(stored(read_pptx(files, max_slides), "pptx"))


def pptx_html(rows: DataFrame) -> DataFrame:
    title = F.when(F.col("title") != "", F.concat(F.lit("<h2>"), "title", F.lit("</h2>"))).otherwise("")
    html = F.concat(F.lit('<div class="slideno">'), F.col("slide").cast("string"), F.lit('</div><div class="slide">'), title, "body", F.lit("</div>"))
    return slides_of(rows).select("path", F.col("slide").alias("seq"), F.lit("slide").alias("kind"), html.alias("html"))


# --- open documents

ODF = "path string, seq int, kind string, text string, image string, content binary, size long"
#: Elements and the tags that they become.
ODF_TAGS = {"text:p": "p", "text:list": "ul", "text:list-item": "li", "table:table": "table", "table:table-row": "tr"}
UNSEEN = ("text:note-body", "office:annotation")


def odf_styles(archive: Container, own: Callable[[], Iterator[Event]]) -> dict[str, str]:
    """CSS of run styles by name: those of the content itself go before the shared ones."""
    css: dict[str, str] = {}
    for part in (own, partial(archive.xml, "styles.xml")):
        name, given = None, {}

        def close() -> None:
            if name:
                lines = " ".join(line for line in ("underline", "line-through") if given.get(line))
                css.setdefault(name, "".join([given.get("bold", ""), given.get("italic", ""), f"text-decoration:{lines};" if lines else "", given.get("color", "")]))

        for ev, tag, attrs, _ in part():
            if ev in ("start", "empty") and tag == "style:style":
                close()
                name, given = attrs.get("name", ""), {}
            elif ev in ("start", "empty") and tag == "style:text-properties":
                given |= {"bold": "font-weight:bold;"} if attrs.get("font-weight") == "bold" else {}
                given |= {"italic": "font-style:italic;"} if attrs.get("font-style") == "italic" else {}
                given |= {"underline": "u"} if attrs.get("text-underline-style", "none") != "none" else {}
                given |= {"line-through": "s"} if attrs.get("text-line-through-style", "none") != "none" else {}
                given |= {"color": f"color:{attrs['color']};"} if re.fullmatch("#[0-9A-Fa-f]{6}", attrs.get("color", "")) else {}
        close()
    return css


def odf_rows(path: str, content: bytes | None) -> Iterator[tuple]:
    archive = Container(content)
    body = archive.part("content.xml")
    yield path, 0, "file", "" if body is not None else NO_PART if archive.ok else NO_ZIP, None, None, None
    if body is None:
        return
    styles, images = odf_styles(archive, body), {}
    level, unseen = "1", 0
    for seq, (ev, name, attrs, text) in enumerate(body()):
        opens, ends = ev in ("start", "empty"), ev == "end"
        if name in UNSEEN:
            unseen += {"start": 1, "end": -1}.get(ev, 0)
        elif unseen > 0:
            continue
        elif ev == "text":
            yield path, seq, "text", text, None, None, None
        elif name == "text:h":
            level = str(max(1, min(6, number(attrs.get("outline-level"), 1)))) if opens else level
            yield path, seq, name, f"<{'' if opens else '/'}h{level}>", None, None, None
        elif name in ODF_TAGS:
            yield path, seq, name, f"<{'' if opens else '/'}{ODF_TAGS[name]}>", None, None, None
        elif name == "text:span" and ev != "empty":
            css = styles.get(attrs.get("style-name", ""), "")
            yield path, seq, name, "</span>" if ends else f'<span style="{css}">' if css else "<span>", None, None, None
        elif name == "table:table-cell":
            yield path, seq, name, None if opens else "</td>", None, None, number(attrs.get("number-columns-spanned"))
        elif opens and name == "text:line-break":
            yield path, seq, name, "<br>", None, None, None
        elif opens and name == "text:tab":
            yield path, seq, name, TAB, None, None, None
        elif opens and name == "draw:image" and "href" in attrs:
            place = attrs["href"].removeprefix("./")
            images.setdefault(place)
            yield path, seq, name, None, place, None, None
    for place in images:
        if (data := archive.read(place)) is not None:
            yield path, 0, "image", None, place, data, None


def read_odf(files: DataFrame) -> DataFrame:
    """What the reader finds in ``path, content`` rows."""
    return expand(files.select("path", "content"), lambda row: odf_rows(row["path"], row["content"]), ODF)


def odf_html(rows: DataFrame) -> DataFrame:
    """The content of open documents, without note bodies and annotations, in order."""
    span = F.when(F.col("size") > 1, F.concat(F.lit(' colspan="'), F.col("size").cast("string"), F.lit('"'))).otherwise("")
    html = F.when(F.col("kind") == "text", escape_html(F.col("text"))).when(F.col("text").isNotNull(), F.col("text")).when(F.col("kind") == "table:table-cell", F.concat(F.lit("<td"), span, F.lit(">"))).when(F.col("uri").isNotNull(), F.concat(F.lit('<img src="'), "uri", F.lit('" alt="">')))
    return with_images(rows, "odf").select("path", "seq", "kind", html.alias("html")).where("html is not null")


def odf_pieces(files: DataFrame) -> DataFrame:
    return odf_html(stored(read_odf(files), "odf"))
