"""Office files from rows: the writers that make test corpora out of tables."""

from __future__ import annotations

import base64
import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from xml.sax.saxutils import escape


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    return _zip({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>"})


def odt(lines: list[str]) -> bytes:
    body = "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<office:document-content><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def pptx(lines: list[str]) -> bytes:
    """A slide per line; the line is its title."""
    slide = '<p:sld><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sp></p:sld>'
    return _zip({"ppt/presentation.xml": "<p:presentation/>"} | {f"ppt/slides/slide{k}.xml": slide.format(escape(x)) for k, x in enumerate(lines, 1)})


def xlsx(lines: list[str]) -> bytes:
    """A row per line, of cells between tabs: text in shared strings, numbers with a date style in every second column."""
    texts = {t: k for k, t in enumerate(dict.fromkeys(c for x in lines for c in x.split("\t")[::2]))}
    rows = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{n}" t="s"><v>{texts[c]}</v></c>' if k % 2 == 0 else f'<c r="{chr(65 + k)}{n}" s="1"><v>{escape(c)}</v></c>' for k, c in enumerate(x.split("\t"))) + "</row>" for n, x in enumerate(lines, 1))
    strings = "".join(f"<si><t>{escape(t)}</t></si>" for t in texts)
    return _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="Sheet" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst>{strings}</sst>", "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def relations(targets: dict[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{escape(v, QUOTE)}"/>' for k, v in targets.items()) + "</Relationships>"


QUOTE = {'"': "&quot;"}
#: A picture of one pixel.
PIXEL = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000001000000010802000000907753de0000000c4944415478da63f8cfc0000003010100c9fe92ef0000000049454e44ae426082")
NUMBERING = '<w:numbering><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num></w:numbering>'


def rich_docx(lines: list[str]) -> bytes:
    """A paragraph per line, of a kind that the text before its first tab tells: a heading, a list item of level 0 or 1,
    a run in bold, italic or colour, deleted text, a link with its target, a row of a table, a picture."""
    body, targets = [], {"pic": "media/p.png", "gone": "media/q.png"}
    for n, line in enumerate(lines):
        kind, _, rest = line.partition("\t")
        run = lambda text, props="": f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
        if kind in ("0", "1"):
            body.append(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{kind}"/><w:numId w:val="7"/></w:numPr></w:pPr>{run(rest)}</w:p>')
        elif kind == "link":
            text, _, targets[f"r{n}"] = rest.partition("\t")
            body.append(f'<w:p><w:hyperlink r:id="r{n}">{run(text)}</w:hyperlink></w:p>')
        elif kind == "row":
            cells = "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in rest.split("\t"))
            body.append(f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>")
        elif kind == "picture":
            body.append(f'<w:p><w:r><w:drawing><wp:extent cx="{rest}"/><a:blip r:embed="pic"/></w:drawing><w:drawing><a:blip r:embed="gone"/></w:drawing></w:r></w:p>')
        elif kind == "deleted":
            body.append(f"<w:p><w:del>{run(rest)}</w:del>{run(rest[:3])}<w:r><w:br/></w:r></w:p>")
        elif kind == "heading":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading3"/><w:jc w:val="both"/></w:pPr>{run(rest)}</w:p>')
        else:
            props = {"bold": "<w:b/><w:i w:val='0'/>", "colour": '<w:color w:val="0a0B0c"/><w:highlight w:val="cyan"/>', "raised": '<w:vertAlign w:val="superscript"/><w:strike/>'}[kind]
            body.append(f"<w:p>{run(rest, props)}</w:p>")
    return _zip({"word/document.xml": f"<w:document><w:body>{''.join(body)}</w:body></w:document>", "word/numbering.xml": NUMBERING, "word/_rels/document.xml.rels": relations(targets), "word/media/p.png": PIXEL})


def rich_odt(lines: list[str]) -> bytes:
    """Lines as in ``rich_docx``: ``heading``, ``bold`` (a style of the text), ``slanted`` (a shared one), ``note``, ``0`` (a list) and ``row``."""
    style = lambda name, props: f'<style:style style:name="{name}"><style:text-properties {props}/></style:style>'
    forms = {
        "heading": '<text:h text:outline-level="9">{}</text:h>', "bold": '<text:p><text:span text:style-name="B">{}</text:span></text:p>', "slanted": '<text:p><text:span text:style-name="S">{}</text:span><text:tab/></text:p>',
        "note": "<text:p>{}<text:note><text:note-body><text:p>hidden</text:p></text:note-body></text:note></text:p>", "0": "<text:list><text:list-item><text:p>{}</text:p></text:list-item></text:list>",
        "row": '<table:table><table:table-row><table:table-cell table:number-columns-spanned="2">{}</table:table-cell></table:table-row></table:table>', "picture": '<text:p>{}<draw:image xlink:href="./Pictures/p.png"/></text:p>',
    }
    body = "".join(forms[x.partition("\t")[0]].format(escape(x.partition("\t")[2])) for x in lines)
    own = style("B", 'fo:font-weight="bold" fo:color="#0a0B0c"')
    shared = style("B", 'fo:font-style="italic"') + style("S", 'fo:font-style="italic" style:text-underline-style="solid"')
    return _zip({"content.xml": f"<office:document-content><office:automatic-styles>{own}</office:automatic-styles><office:text>{body}</office:text></office:document-content>", "styles.xml": f"<office:styles>{shared}</office:styles>", "Pictures/p.png": PIXEL})


def rich_pptx(lines: list[str]) -> bytes:
    """A slide per line: a title, a tab and a paragraph, an empty paragraph and a picture."""
    slide = '<p:sld><p:sp><p:ph type="ctrTitle"/><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sp><p:sp><a:p></a:p><a:p><a:r><a:t>{}</a:t></a:r><a:br/></a:p></p:sp><a:blip r:embed="pic"/><a:blip r:embed="none"/></p:sld>'
    slides = {f"ppt/slides/slide{k}.xml": slide.format(*map(escape, x.partition("\t")[::2])) for k, x in enumerate(lines, 1)}
    rels = {f"ppt/slides/_rels/slide{k}.xml.rels": relations({"pic": "../media/p.png"}) for k, _ in enumerate(lines, 1)}
    return _zip({"ppt/presentation.xml": "<p:presentation/>", "ppt/media/p.png": PIXEL} | slides | rels)


def rich_xlsx(lines: list[str]) -> bytes:
    """Two sheets: rows of a text, a gap, a percentage, a time and a flag; and inline texts, by a full path. Lines hold the text and a number."""
    first, second = [], []
    for x in lines:
        text, _, n = x.partition("\t")
        first.append(f'<row><c r="A1" t="str"><f>1</f><v>{escape(text)}</v></c><c r="C1" s="1"><v>{int(n) / 100}</v></c><c r="D1" s="2"><v>{int(n) / 64}</v></c><c r="E1" s="3"><v>{n}</v></c><c t="b"><v>{int(n) % 2}</v></c></row>')
        second.append(f'<row><c r="B1" t="inlineStr"><is><t>{escape(text)}</t></is></c></row>')
    formats = '<numFmt numFmtId="170" formatCode="0.0%"/><numFmt numFmtId="171" formatCode="[h]:mm &quot;d&quot; ss"/><numFmt numFmtId="170" formatCode="yyyy"/>'
    sheet = "<worksheet><sheetData>{}</sheetData></worksheet>"
    return _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="A &amp; B" r:id="a"/><sheet name="C" r:id="c"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations({"a": "worksheets/x.xml", "c": "/xl/worksheets/y.xml"}), "xl/styles.xml": f'<styleSheet><numFmts>{formats}</numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="3"/></cellXfs></styleSheet>', "xl/worksheets/x.xml": sheet.format("".join(first)), "xl/worksheets/y.xml": sheet.format("".join(second))})


def lzw_packed(data: bytes) -> bytes:
    """Codes of nine bits only: the table is cleared before it grows beyond them."""
    import numpy as np

    codes = np.array([c for at in range(0, len(data), 200) for c in (256, *data[at : at + 200])] + [257], np.uint16)
    return np.packbits(codes[:, None] >> np.arange(8, -1, -1, dtype=np.uint16) & 1).tobytes()


def pdf(lines: list[str], form: int | None = None, per_line: int = 12) -> bytes:
    """A page per line, with so many words in a row, and a link on every other page. The number of lines tells the form: words
    as kerned, placed or whole strings, packed in three ways (LZW on every eighth page), found by a table, by a packed stream with packed objects, or not at all."""
    form = len(lines) % 3 if form is None else form
    coded = lambda w: codecs.utf_16_be_encode(w, "surrogatepass")[0]
    literal = lambda raw: b"(" + re.sub(rb"([()\\\r\n])", lambda m: b"\\%03o" % m[1][0], raw) + b")"

    def drawn(line: str) -> bytes:
        words, out = re.findall(r"[^\x20\x09-\x0D]+", line), [b"q 2 0 0 2 9 700 cm BT /F1 10 Tf 14 TL"]
        strings = [coded(w).hex() for w in words] if form < 2 else words
        for at in range(0, len(words), per_line):
            row = strings[at : at + per_line]
            if form == 0:
                out.append(f"[<{'> -300 <'.join(row)}>] TJ T*".encode())
            elif form == 1:
                steps = [len(x) // 4 * 5 + 3 for x in row]
                out.append("\n".join([*(f"<{x}> Tj {n} 0 Td" for x, n in zip(row, steps, strict=True)), f"{-sum(steps)} -14 Td"]).encode())
            else:
                out.append(literal(coded(" ".join(row))) + b" Tj T*")
        return b"\n".join([*out, b"ET Q BI /W 1 ID (ET EI"])

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    n = len(lines)
    stream = lambda about, raw: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (about, len(raw), raw)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /DescendantFonts [<< /DW 500 >>] /ToUnicode 4 0 R >>", 4: stream(b"", cmap)}
    objects[2] = b"<< /Type /Pages /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(n)))
    for k, line in enumerate(lines):
        note = b"/Annots [<< /Subtype /Link /Rect [1 2 3 4] /A << /URI (https://h.example/%d) >> >>]" % k if k % 2 else b"/MediaBox [0 0 %d 800]" % (500 + k % 100)
        objects[5 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s >>" % (6 + 2 * k, note)
        raw = drawn(line)
        objects[6 + 2 * k] = stream(b"/Filter /FlateDecode", zlib.compress(raw)) if form == 0 or form == 1 and k % 8 else stream(b"/Filter [/ASCII85Decode /LZWDecode]", base64.a85encode(lzw_packed(raw)) + b"~>") if form == 1 else stream(b"", raw)
    out, places = bytearray(b"%PDF-1.7\n"), {}
    if form == 1:
        inner = [k for k, v in objects.items() if b"stream\n" not in v]
        heads, bodies, at = [], [], 0
        for k in inner:
            heads.append(b"%d %d" % (k, at))
            bodies.append(objects.pop(k) + b"\n")
            at += len(bodies[-1])
        first = b" ".join(heads) + b"\n"
        holder = 5 + 2 * n
        objects[holder] = stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(inner), len(first)), zlib.compress(first + b"".join(bodies)))
    for k, body in objects.items():
        places[k] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    at = len(out)
    if form == 1:
        places |= {k: (2, holder, i) for i, k in enumerate(inner)} | {0: (0, 0, 0), holder + 1: (1, at, 0)}
        rows = [bytes([a]) + b.to_bytes(4) + c.to_bytes(2) for _, (a, b, c) in sorted(places.items())]
        above = [bytes(7), *rows]
        packed_rows = b"".join(b"\x02" + bytes((x - y) % 256 for x, y in zip(r, u, strict=True)) for r, u in zip(rows, above, strict=False))
        out += b"%d 0 obj\n%s\nendobj\n" % (holder + 1, stream(b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>" % (holder + 2), zlib.compress(packed_rows)))
    elif form == 0:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (k, p) for k, (_, p, _) in places.items()) + b"trailer << /Root 1 0 R /Size %d >>\n" % (5 + 2 * n)
    return bytes(out + b"startxref\n%d\n%%%%EOF" % (at if form < 2 else 7))


WRITERS = {"pdf": pdf, "docx": docx, "odt": odt, "pptx": pptx, "xlsx": xlsx, "rich_docx": rich_docx, "rich_odt": rich_odt, "rich_pptx": rich_pptx, "rich_xlsx": rich_xlsx}


def packed(df: DataFrame, kind: str) -> DataFrame:
    """``path, content`` of ``path, lines`` rows."""
    write = WRITERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [write([x for x in lines or []]) for lines in part.column("lines").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(made, pa.binary())], names=["path", "content"])

    return df.select("path", "lines").mapInArrow(run, "path string, content binary")
