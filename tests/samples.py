"""Small files of every kind, made from the formats' public specifications."""

import io
import json
import struct
import zipfile
import zlib


def png(rgb=(30, 90, 160), width=3, height=1):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    scan = b"\x00" + bytes(rgb) * width
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(scan * height)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 7, 5, 0, 0, 0) + b";"
BMP = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, -2, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc2" + struct.pack(">HBHHB", 8, 8, 11, 13, 0) + b"\xff\xd9"


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def links(**targets):
    return "<Relationships xmlns='r'>" + "".join(f"<Relationship Id='{k}' Type='t' Target='{v}'/>" for k, v in targets.items()) + "</Relationships>"


def run(text, *props):
    return f"<w:r>{'<w:rPr>' + ''.join(props) + '</w:rPr>' if props else ''}<w:t>{text}</w:t></w:r>"


def para(*inner, props=""):
    return f"<w:p>{'<w:pPr>' + props + '</w:pPr>' if props else ''}{''.join(inner)}</w:p>"


def item(text, level, number):
    return para(run(text), props=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def tide_log():
    """A word document: styles, runs, lists of two kinds, a table, links and pictures."""
    picture = lambda rid: para(f'<w:r><w:drawing><wp:extent cx="1905000" cy="9525"/><a:blip r:embed="{rid}"/></w:drawing></w:r>')
    body = [
        para(run("Tide log"), props='<w:pStyle w:val="title"/><w:jc w:val="center"/>'),
        para(run("Week 31"), props='<w:pStyle w:val="Heading9"/>'),
        para(run("High water "), run("09:14", "<w:b/>", "<w:i/>"), run(" at the ", '<w:b w:val="0"/>'), run("old", "<w:strike/>"), run(" pier", "<w:u w:val='single'/>"), run("m", '<w:vertAlign w:val="superscript"/>'), run("i", '<w:vertAlign w:val="subscript"/>')),
        para(run("storm", '<w:color w:val="1E5AA0"/>', '<w:highlight w:val="yellow"/>'), run("calm", '<w:color w:val="auto"/>', '<w:highlight w:val="none"/>'), props='<w:jc w:val="both"/>'),
        item("ropes", 0, 4), item("spare ropes", 1, 4), item("lamps", 0, 4), item("cast off", 0, 9), item("log it", 0, 9),
        para("<w:del><w:r><w:t>struck out</w:t></w:r></w:del>", "<w:r><w:instrText>DATE</w:instrText></w:r>", run("wind &lt; 4 &amp; rising"), "<w:r><w:br/></w:r>", "<w:r><w:tab/></w:r>", run("gusts")),
        "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='3'/></w:tcPr>" + para(run("berths")) + "</w:tc></w:tr><w:tr>" + "".join(f"<w:tc>{para(run(x))}</w:tc>" for x in ("north", "south", "quay")) + "</w:tr></w:tbl>",
        para('<w:hyperlink r:id="chart">', run("chart"), '</w:hyperlink><w:hyperlink r:id="trap">', run("trap"), '</w:hyperlink><w:hyperlink r:id="lost" w:anchor="week31">', run("back"), "</w:hyperlink>"),
        picture("buoy"), picture("gone"), picture("odd"), picture("nowhere"),
        "<w:p/>",
    ]
    numbering = (
        '<w:numbering><w:abstractNum w:abstractNumId="20"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>'
        '<w:abstractNum w:abstractNumId="21"/><w:num w:numId="4"><w:abstractNumId w:val="20"/></w:num><w:num w:numId="9"><w:abstractNumId w:val="21"/></w:num></w:numbering>'
    )
    rels = links(chart="https://harbour.example/c?x=1&amp;y=2", trap="javascript:void(0)", buoy="media/buoy.png", gone="media/none.png", odd="/word/media/odd.xyz")
    return archive({"word/document.xml": f"<w:document><w:body>{''.join(body)}</w:body></w:document>", "word/numbering.xml": numbering, "word/_rels/document.xml.rels": rels, "word/media/buoy.png": png(), "word/media/odd.xyz": b"??"})


def gauge_book():
    """A workbook: three sheets (one by a full path, one without a relationship), gaps, flags, dates and formats."""
    strings = "<sst><si><t>Gauge</t><rPh><t>sound</t></rPh></si><si><r><t>read </t></r><r><t>at</t></r></si><si/></sst>"
    styles = (
        "<styleSheet><numFmts><numFmt numFmtId='171' formatCode='d.m. \"o\"hh'/><numFmt numFmtId='172' formatCode='0.00%'/><numFmt numFmtId='172' formatCode='yyyy'/><numFmt formatCode='yyyy'/></numFmts>"
        "<cellStyleXfs><xf numFmtId='10'/></cellStyleXfs><cellXfs><xf/><xf numFmtId='21'/><xf numFmtId='171'/><xf numFmtId='172'/></cellXfs></styleSheet>"
    )
    first = (
        "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c><c r='C1' t='s'><v>77</v></c></row>"
        "<row r='2'><c r='B2'><f>1+1</f><v>2.50</v></c><c r='E2' t='b'><v>0</v></c><c t='b'><v>1</v></c></row>"
        "<row r='3'><c r='A3' s='1'><v>0.75</v></c><c r='B3' s='2'><v>44927.5</v></c><c r='C3' s='3'><v>0.3</v></c><c r='D3' s='99'><v>7</v></c></row>"
    )
    second = "<row><c r='A1' t='inlineStr'><is><r><t>by </t></r><r><t>hand</t></r></is></c><c r='A1' t='str'><v>x &amp; y</v></c><c r='C1' t='e'><v>#N/A</v></c></row>"
    parts = {"xl/workbook.xml": "<workbook><sheets><sheet name='Low &amp; high' r:id='p'/><sheet name='Notes' r:id='q'/><sheet name='Third' r:id='none'/><sheet r:id='p'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": links(p="worksheets/one.xml", q="/xl/worksheets/two.xml"), "xl/sharedStrings.xml": strings, "xl/styles.xml": styles}
    bodies = {"one": first, "two": second, "sheet3": "<row><c><v>only</v></c></row>"}
    return archive(parts | {f"xl/worksheets/{k}.xml": f"<worksheet><sheetData>{v}</sheetData></worksheet>" for k, v in bodies.items()})


def crew_deck(numbers=(1, 2, 3, 5)):
    """A presentation with a gap in its slide numbers; titles of both kinds, empty paragraphs, a picture."""
    shape = lambda inner, kind="": f"<p:sp><p:nvSpPr>{f'<p:nvPr><p:ph type=\"{kind}\"/></p:nvPr>' if kind else ''}</p:nvSpPr><p:txBody>{inner}</p:txBody></p:sp>"
    said = lambda *texts: "<a:p>" + "<a:br/>".join(f"<a:r><a:t>{t}</a:t></a:r>" for t in texts) + "</a:p>"
    parts = {"ppt/presentation.xml": "<p:presentation/>", "ppt/media/buoy.png": png(), "ppt/media/note.svg": b"<svg/>"}
    for n in numbers:
        title = shape(said(f"Watch {n}") + said("subtitle"), "ctrTitle" if n == 1 else "title") if n != 3 else ""
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld>{title}{shape(said('bow', 'stern') + '<a:p></a:p>')}<a:blip r:embed='x'/><a:blip r:embed='y'/></p:sld>"
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = links(x="../media/buoy.png", y="/ppt/media/note.svg")
    return archive(parts)


def manual():
    """An open document: own and shared styles, a note, a list, a table, a picture."""
    style = lambda name, props: f"<style:style style:name='{name}'><style:text-properties {props}/></style:style>"
    body = (
        "<text:h text:outline-level='2'>Knots</text:h><text:h text:outline-level='11'>Bends</text:h>"
        "<text:p>tie <text:span text:style-name='S1'>twice</text:span>, <text:span text:style-name='S2'>pull</text:span>, <text:span text:style-name='S3'>rest</text:span>"
        "<text:note><text:note-citation>1</text:note-citation><text:note-body><text:p>unseen</text:p></text:note-body></text:note><office:annotation><text:p>remark</text:p></office:annotation><text:line-break/>end<text:tab/></text:p>"
        "<text:list><text:list-item><text:p>reef</text:p></text:list-item><text:list-item><text:p>bowline</text:p></text:list-item></text:list>"
        "<table:table><table:table-row><table:table-cell table:number-columns-spanned='4'><text:p>loads</text:p></table:table-cell><table:table-cell/></table:table-row></table:table>"
        "<text:p><draw:frame><draw:image xlink:href='./Pictures/buoy.png'/></draw:frame></text:p>"
    )
    content = "<office:document-content><office:automatic-styles>" + style("S1", "fo:font-weight='bold' fo:color='#1E5AA0'") + style("S2", "style:text-underline-style='solid' style:text-line-through-style='none'") + f"</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>"
    shared = "<office:document-styles><office:styles>" + style("S2", "fo:font-weight='bold'") + style("S3", "fo:font-style='italic'") + "</office:styles></office:document-styles>"
    return archive({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content, "styles.xml": shared, "Pictures/buoy.png": png()})


def soundings():
    outputs = [
        {"output_type": "stream", "name": "stderr", "text": ["shallow\n", "water\n"]},
        {"output_type": "execute_result", "data": {"text/html": "<i>3 m</i>", "text/plain": ["3", " m"]}},
        {"output_type": "display_data", "data": {"image/gif": "R0lG\nODdh"}},
        {"output_type": "error", "traceback": ["\x1b[1;33mDepthError\x1b[0m: -1", "at 4"]},
        {"output_type": "unknown"},
    ]
    cells = [
        {"cell_type": "markdown", "source": ["## Depths\n", "\n", "by *lead line*"]},
        {"cell_type": "code", "execution_count": 12, "source": "lead(line='A<B')", "outputs": outputs},
        {"cell_type": "code", "execution_count": None, "source": [], "outputs": []},
        {"cell_type": "raw", "source": "5 < 6"},
        {"cell_type": "heading", "source": "left out"},
    ]
    return json.dumps({"metadata": {"language_info": {"name": ""}, "kernelspec": {"language": "julia"}}, "cells": cells}).encode()


RTF = rb"{\rtf1{\fonttbl{\f0 Courier;}}{\*\generator none;}{\info hidden}sails {\b up\i  now}\line down{\uc1\u8364 ?5}\par {\ul all}\ulnone\tab hands\~on \'99 \{deck\}}"

MARKDOWN = """Mooring notes
=============

Use **two** ropes and *one* `cleat`, see <https://harbour.example> or [rules](rules.md "all of them").

![buoy](img/../buoy.png) ![lost](lost.png)

~~~sh
make fast
~~~

left | right
:--- | ---:
1 | 2 \\| 3

* [X] bow line
* [ ] stern line
    * spring

3) third
4) fourth

> lee shore

- - -
""".encode()

TRAPS = b"""<img src=x onerror=y>

[p](JAVAscript:z) [q](&#106;avascript:z) [r](vbscript:z) [s](mailto:crew@harbour.example) [t](deck/plan.md#a:b)

![u](cargo.txt) ![v](/c/buoy.png)
"""


def files():
    return {
        "/c/buoy.png": png(),
        "/c/notes.md": MARKDOWN,
        "/c/traps.md": TRAPS,
        "/c/cargo.txt": b"HIDDEN CARGO",
        "/c/crew.json": b'[{"cook":{},"ages":[31,[]]},"a:\\"b",-2e1,null]',
        "/c/berths.csv": b'berth;"boat; or none";m\r\n1;"the ""Gull"" ";12\r4;\r\n\n',
        "/c/tides.tsv": b"low,1\thigh\n0.4\t3.1",
        "/c/pump.py": b"if a < b:\n    run()\n",
        "/c/dump.bin": bytes(range(255, -1, -1)) * 3,
        "/c/log.docx": tide_log(),
        "/c/gauges.xlsx": gauge_book(),
        "/c/crew.pptx": crew_deck(),
        "/c/manual.odt": manual(),
        "/c/depths.ipynb": soundings(),
        "/c/sails.rtf": RTF,
        "/c/torn.docx": b"PK\x03\x04 torn off",
        "/c/hollow.xlsx": archive({"xl/workbook.xml": "<workbook/>"}),
        "/c/pages.pdf": b"%PDF-1.7 << /Type /Pages >> " + b"<< /Type/Page >> " * 2,
        "/c/grey.pgm": b"P5 1 1 255 \x40",
        "/c/home.html": b"<p>left as it stands</p>",
        "/c/none.csv": b"",
        "/c/bad.psd": b"8BPS?",
        "/c/cut.ipynb": b'{"cells": [',
        "/c/three.ipynb": b'{"worksheets": [{"cells": []}]}',
    }
