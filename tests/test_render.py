"""Every kind of file becomes one row, with the strings that must and must not be in it."""

import base64

import pytest

from folio.operators import spreadsheet
from folio.plans.render import render
from tests import samples


@pytest.fixture(scope="module")
def pages(spark):
    made = samples.files()
    rows = render(spark.createDataFrame(list(made.items()), "path string, content binary")).collect()
    assert sorted(r.path for r in rows) == sorted(made)
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


PNG = "data:image/png;base64," + base64.b64encode(samples.png()).decode()

HOLDS = {
    "buoy.png": [f'<img src="{PNG}"', "<title>buoy.png</title>"],
    "notes.md": [
        "<h1>Mooring notes</h1>", "<strong>two</strong>", "<em>one</em>", "<code>cleat</code>", 'href="https://harbour.example"', 'href="rules.md" title="all of them"',
        f'<img src="{PNG}" alt="buoy">', '<img src="lost.png" alt="lost">', '<code class="language-sh">make fast', '<th align="left">left</th>', '<td align="right">2 | 3</td>',
        'disabled checked>bow line', 'disabled>stern line', "<ul>\n<li>spring</li>", '<ol start="3">', "<blockquote>\n<p>lee shore</p>", "<hr>", "default-src 'none'",
    ],
    "traps.md": ["&lt;img src=x onerror=y&gt;", '<a href="#blocked">p</a> <a href="#blocked">q</a> <a href="#blocked">r</a>', 'href="mailto:crew@harbour.example"', 'href="deck/plan.md#a:b"', PNG, "<span></span>"],
    "crew.json": ["[\n  {\n    &quot;cook&quot;: {},\n    &quot;ages&quot;: [\n      31,\n      []\n    ]\n  },\n  &quot;a:\\&quot;b&quot;,\n  -2e1,\n  null\n]", "language-json"],
    "berths.csv": ["<th>berth</th><th>boat; or none</th><th>m</th></tr></thead>", '<td class="rownum">1</td><td>1</td><td>the &quot;Gull&quot; </td><td>12</td>', '<td class="rownum">2</td><td>4</td><td></td></tr>', '<td class="rownum">3</td><td></td></tr></tbody>'],
    "tides.tsv": ["<th>low,1</th><th>high</th>", "<td>0.4</td><td>3.1</td>"],
    "pump.py": ['class="language-py"', "if a &lt; b:"],
    "dump.bin": ["This file can't be shown", "00000000  ff fe fd fc fb fa f9 f8  f7", "... (256 more bytes)", "000001f0", "|ONMLKJIHGFEDCBA@|"],
    "log.docx": [
        '<h1 style="text-align:center">Tide log</h1><h6>Week 31</h6>', "High water <b><i>09:14</i></b> at the <s>old</s><u> pier</u><sup>m</sup><sub>i</sub>",
        '<p style="text-align:justify"><span style="color:#1E5AA0;background:yellow;">storm</span>calm</p>',
        "<ul><li>ropes</li><ol><li>spare ropes</li></ol><li>lamps</li></ul><ol><li>cast off</li><li>log it</li></ol><p>wind &lt; 4 &amp; rising<br><span",
        '<table class="docxtbl"><tr><td colspan="3"><p>berths</p></td></tr><tr><td><p>north</p></td>',
        '<a href="https://harbour.example/c?x=1&amp;y=2">chart</a><a href="#blocked">trap</a><a href="#week31">back</a>',
        f'<p><img src="{PNG}" alt="" style="width:200px"></p><p><span class="missing-img">(picture missing)</span></p><p><span class="missing-img">(picture of another kind)</span></p><p></p></div>',
    ],
    "gauges.xlsx": [
        "Low &amp; high</h2><table><tr><td>Gauge</td><td>read at</td><td></td></tr><tr><td></td><td>2.50</td><td></td><td></td><td>FALSE</td><td>TRUE</td></tr><tr><td>18:00:00</td><td>2023-01-01 12:00</td><td>30%</td><td>7</td></tr></table>",
        "Notes</h2><table><tr><td>by hand</td><td>x &amp; y</td><td></td><td>#N/A</td></tr></table>", "Third</h2><table><tr><td>only</td></tr></table>",
    ],
    "crew.pptx": [f'<div class="slideno">1</div><div class="slide"><h2>Watch 1</h2><p>subtitle</p><p>bow stern</p><img src="{PNG}" alt=""></div>', "<h2>Watch 2</h2>", '<div class="slideno">3</div><div class="slide"><p>bow'],
    "manual.odt": [
        "<h2>Knots</h2><h6>Bends</h6>", 'tie <span style="font-weight:bold;color:#1E5AA0;">twice</span>, <span style="text-decoration:underline;">pull</span>, <span style="font-style:italic;">rest</span>1<br>end<span',
        "<ul><li><p>reef</p></li><li><p>bowline</p></li></ul>", '<tr><td colspan="4"><p>loads</p></td><td></tr>', f'<p><img src="{PNG}" alt=""></p>',
    ],
    "depths.ipynb": ["<h2>Depths</h2>", "<em>lead line</em>", "In [12]:", "In [ ]:", "language-julia", "lead(line=&#39;A&lt;B&#39;)", '<pre class="nb-out nb-err">shallow\nwater\n</pre>', ">3 m</pre>", "data:image/gif;base64,R0lGODdh", "DepthError: -1\nat 4", "5 &lt; 6"],
    "sails.rtf": ["<p>sails <b>up<i> now</i></b><br>down", "€5</p>", "<u>all</u>", "hands&nbsp;on ™ {deck}</p>"],
    "torn.docx": ["This word document can&#39;t be read", "no ZIP archive"],
    "hollow.xlsx": ["This workbook can&#39;t be read", "none of its sheets"],
    "pages.pdf": ["data:application/pdf;base64,", "blob:", "2 pages"],
    "grey.pgm": ["data:image/png;base64,"],
    "none.csv": ["<table>"],
    "bad.psd": ["This picture can&#39;t be decoded", "psd"],
    "cut.ipynb": ["it is no JSON"],
    "three.ipynb": ["no list of cells"],
    "home.html": ["<p>left as it stands</p>"],
    "cargo.txt": ["HIDDEN CARGO"],
}
LACKS = {
    "notes.md": ["<script"],
    "traps.md": ["<img src=x", "avascript:", "HIDDEN"],
    "log.docx": ["struck out", "DATE", "javascript:"],
    "gauges.xlsx": ["sound", "1+1", "Cut off"],
    "crew.pptx": ["Watch 5", "<p></p>", "svg"],
    "manual.odt": ["unseen", "remark"],
    "depths.ipynb": ["\x1b", "left out", "<i>3"],
    "sails.rtf": ["Courier", "none;"],
    "none.csv": ["<thead>"],
    "berths.csv": ["Cut off"],
}


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_holds(pages, name):
    for part in HOLDS[name]:
        assert part in pages[name].html


@pytest.mark.parametrize("name", sorted(LACKS))
def test_lacks(pages, name):
    for part in LACKS[name]:
        assert part not in pages[name].html


def test_errors_are_rows(pages):
    assert {n for n, r in pages.items() if r.error_message} == {"torn.docx", "hollow.xlsx", "bad.psd", "cut.ipynb", "three.ipynb"}
    assert pages["home.html"].url == "file:///c/home.html"


def test_offline_drops_remote_images(spark):
    df = spark.createDataFrame([("/a.txt", b"x")], "path string, content binary")
    assert "img-src data:;" in render(df, offline=True).first().html
    assert render(df.limit(0)).count() == 0


def test_limits_of_workbooks_at_under_and_over(spark):
    rows = "".join(f"<row><c><v>{k}</v></c></row>" for k in range(5))
    book = samples.archive({"xl/workbook.xml": "<workbook><sheets><sheet name='a' r:id='1'/><sheet name='b' r:id='2'/></sheets></workbook>", "xl/worksheets/sheet1.xml": rows, "xl/worksheets/sheet2.xml": "<row><c r='C1'><v>x</v></c></row>"})
    files = spark.createDataFrame([("/b.xlsx", book)], "path string, content binary")
    for limit, kept, more in ((4, 4, True), (5, 5, False), (6, 5, False), (None, 5, False)):
        found = spreadsheet.read_xlsx(files, max_rows=limit)
        sheet = found.where("kind = 'sheet' and sheet_idx = 0").first()
        assert (sheet.row_idx, sheet.truncated) == (kept, more)
        assert spreadsheet.cells_of(found).where("sheet_idx = 0").count() == kept
    assert {r.sheet_idx for r in spreadsheet.xlsx_cells(files, max_sheets=1).collect()} == {0}
    wide = {n: sorted((r.col_idx, r.display) for r in spreadsheet.xlsx_cells(files, max_cols=n).where("sheet_idx = 1").collect()) for n in (2, 3, None)}
    assert wide == {2: [(0, "x")], 3: [(0, ""), (1, ""), (2, "x")], None: [(0, ""), (1, ""), (2, "x")]}
