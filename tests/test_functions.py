"""Scalar functions and classification on literal cases."""

import base64
import datetime
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import classify as K
from folio.functions import pictures as P
from folio.functions import text as X
from folio.operators.delimited import csv_cells, split_rows
from folio.operators.markdown import MAX_NESTING, inline, to_html
from folio.operators.office import list_tags
from folio.operators.pdf import pdf_info
from folio.operators.richtext import runs
from tests import samples


@pytest.fixture(scope="module")
def apply(spark):
    def run(make, values, kind="string"):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
        return [r.o for r in df.select("k", make(F.col("v")).alias("o")).orderBy("k").collect()]

    return run


def test_paths(apply):
    assert apply(X.extension, ["a/b.TXT", ".bashrc", "a.", "x.abcdefghijklmnop", "x.abcdefghijklmno", "a.b/c", "f.c++", "e.x y", None]) == ["txt", "", "", "", "abcdefghijklmno", "", "c++", "", None]
    assert apply(X.basename, ["/a/b", "b", "/a/"]) == ["b", "b", ""]
    assert apply(X.parent, ["/", "/a", "/a/b/", "/a/b/c"]) == [None, "/", "/a", "/a/b"]
    assert apply(lambda c: X.join_path(c, F.lit("n")), ["/", "/a", "/a/"]) == ["/n", "/a/n", "/a/n"]


def test_links(apply):
    urls = [" jAv\taScript:x", "mailto:a", "/a:b", "#x", "ftp://x", "HTTPS://a", "", "a" * 31 + ":x", "data:x"]
    assert apply(X.safe_link, urls) == [False, True, True, True, False, True, True, True, False]


def test_entities(apply):
    assert apply(X.xml_decode, ["&amp;lt;", "&#65;&#x42;&euro;", "&quot;&apos;&", None, "&#0;&#xD800;"]) == ["&lt;", "AB&euro;", "\"'&", None, "&#0;&#xD800;"]
    assert apply(X.escape_html, ["<a href='x'>&\"", None]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;", None]


def test_sizes(apply):
    assert apply(X.human_size, [0, 1023, 1024, 1280, 1331, 1536 * 1024, 5 * 2**40], "long") == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.3 KB", "1.5 MB", "5.0 TB"]


def test_data_uri_has_no_line_breaks(apply):
    data = bytes(range(256))
    assert apply(lambda c: X.data_uri(F.lit("a/b"), c), [data], "binary") == ["data:a/b;base64," + base64.b64encode(data).decode()]


def test_json(apply):
    cases = {'{"a":[],"b":{"c":1}}': '{\n  "a": [],\n  "b": {\n    "c": 1\n  }\n}', "[1,2]": "[\n  1,\n  2\n]", '{ }': "{}", '{"x":"a{,}\\"b"}': '{\n  "x": "a{,}\\"b"\n}', "}{": "\n}{\n  ", '"open': '"open', "[}": "[\n  \n}"}
    assert apply(X.json_reindent, list(cases)) == list(cases.values())


def test_ansi(apply):
    assert apply(X.strip_ansi, ["a\x1b[31mb\x1b[0m", "plain"]) == ["ab", "plain"]


def test_spreadsheet_numbers(apply):
    assert apply(X.column_of_ref, ["A1", "XFD1", "ABCDE1", "a1", "", "AA1"]) == [0, 16383, 19009, -1, -1, 26]
    assert apply(lambda c: X.serial_text(c, F.lit("datetime")), [45658.75, 45658.0, 1.5], "double") == ["2025-01-01 18:00", "2025-01-01 00:00", "1899-12-31 12:00"]
    assert apply(lambda c: X.serial_text(c, F.lit("time")), [0.5, 0.999999], "double") == ["12:00:00", "00:00:00"]
    assert apply(X.percent_text, [0.125, 1.0, 1e-7], "double") == ["12.5%", "100%", "1e-05%"]
    assert apply(X.leading_number, ["12.5x", "abc", "-3", "1e2!", ""]) == [12.5, 0.0, -3.0, 100.0, 0.0]
    assert apply(X.custom_format, ["yyyy-mm-dd", "h:mm", "d h", '"day" 0', "[red]0%", "mm", "\\d0"]) == ["date", "time", "datetime", "general", "percent", "general", "general"]


def test_hex_dump(apply):
    text = apply(X.hex_dump, [bytes(range(20)), b"", b"x" * 600], "binary")
    assert text[0].split("\n")[0] == "00000000  00 01 02 03 04 05 06 07  08 09 0a 0b 0c 0d 0e 0f  |................|"
    assert text[0].split("\n")[1].startswith("00000010  10 11 12 13 ") and text[1] == "" and text[2].endswith("... (88 more bytes)")


def test_picture_sizes(spark):
    cases = {samples.png(width=3, height=1): (3, 1), samples.GIF: (7, 5), samples.BMP: (4, 2), samples.JPEG: (13, 11), b"GIF8": None, b"\xff\xd8\xff": None, b"\xff\xd8\xff\xe0\xff\xff": None, b"plain": None}
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c binary").select("k", K.image_size(F.col("c")).alias("s")).orderBy("k").collect()
    assert [tuple(r.s) if r.s and r.s.width else None for r in rows] == list(cases.values())


def test_sizes_in_chunks_and_boxes():
    svg = lambda attrs: P.size_of(f"<?xml?><svg {attrs}>".encode())
    assert [svg(a) for a in ("width='10' height='20'", "width='1in' height='36pt'", "viewBox='0 0 30 15'", "viewBox='0,0,30,15' height='5'", "width='100%' height='3'", "", "width='5em' viewBox='0 0 3 0'")] == [(10, 20), (96, 48), (30, 15), (10, 5), P.NONE, P.NONE, P.NONE]
    assert P.size_of(b"<s:svg width='1' height='2'/>") == (1, 2) and P.size_of(b"<p>svg</p>") == P.NONE and P.size_of(None) == P.NONE
    assert P.size_of(b"\0\0\1\0\2\0" + bytes([0, 0]) + bytes(14) + bytes([16, 16]) + bytes(14)) == (256, 256) and P.size_of(b"\0\0\1\0\x09\0") == P.NONE
    box = lambda kind, body: (8 + len(body)).to_bytes(4) + kind + body
    ispe = lambda w, h: box(b"ispe", bytes(4) + w.to_bytes(4) + h.to_bytes(4))
    loose = box(b"ftyp", b"avif") + box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", ispe(3, 4) + ispe(5, 6))))
    assert P.size_of(loose) == (5, 6)
    wide = box(b"ipma", b"\1\0\0\1" + (1).to_bytes(4) + (7).to_bytes(4) + b"\1" + (0x8001).to_bytes(2))
    assert P.size_of(box(b"ftyp", b"avif") + box(b"meta", bytes(4) + box(b"pitm", b"\1\0\0\0" + (7).to_bytes(4)) + box(b"iprp", box(b"ipco", ispe(3, 4) + ispe(5, 6)) + wide))) == (3, 4)
    rnd = random.Random(8)
    for _ in range(2000):  # whatever the bytes are, it ends
        raw = bytearray(loose * 2)
        for _ in range(5):
            raw[rnd.randrange(len(raw))] = rnd.choice((0, 1, 8, 255))
        P.size_of(bytes(raw))
        P.size_of(b"RIFF0000WEBP" + bytes(rnd.randrange(256) for _ in range(30)))


def test_pages_in_object_streams(spark):
    packed = zlib.compress(b"1 0 2 20 << /Type /Page >> << /Type /Pages >> << /Type/Page/Parent 2 0 R >>")
    data = b"%PDF-1.5\n3 0 obj << /Type /ObjStm /N 2 /Filter /FlateDecode >>\nstream\r\n" + packed + b"\nendstream\n<< /Type /Page >>"
    files = spark.createDataFrame([("/a", data), ("/b", data.replace(packed, b"damaged")), ("/c", b"%PDF-1.4"), ("/d", None)], "path string, content binary")
    assert [r.note for r in pdf_info(files).orderBy("path").collect()] == ["3 pages", "1 page", None, None]


def test_detection(spark):
    cases = [("notes.md", b"a\x00b", "binary"), ("notes.md", b"%PDF-1.4 all text", "markdown"), ("x", b"%PDF-", "pdf"), ("x.png", b"text", "image"), ("x", b"plain", "text"), ("x", b"", "text"), ("x.txt", b"\x89PNG\r\n\x1a\n\x00\x00", "image"), ("x", b"BM" + b"\0" * 20, "binary"), ("a.docx", b"nonsense", "docx")]
    rows = spark.createDataFrame([(k, p, c) for k, (p, c, _) in enumerate(cases)], "k int, path string, content binary").select("k", K.detect(F.col("path"), F.col("content")).alias("t")).orderBy("k").collect()
    assert [r.t for r in rows] == [t for *_, t in cases]


def rows_of(text, delimiter=",", most=10_000):
    out = {}
    for r, c, v in split_rows(text, delimiter, most):
        out.setdefault(r, []).append(v)
    return list(out.values())


def test_csv_rules():
    assert rows_of("a,b\n1\n1,2,3\n\n") == [["a", "b"], ["1"], ["1", "2", "3"], [""]]
    assert rows_of("a,b,") == [["a", "b"]] and rows_of("a,b,\n") == [["a", "b", ""]]
    assert rows_of('"x""y" junk,z\r\n"open, to the\nend') == [['x"y', "z"], ["open, to the\nend"]]
    assert rows_of("a\rb\r\nc") == [["a"], ["b"], ["c"]] and rows_of("") == []
    assert rows_of("a\n" * 10, most=3) == [["a"], ["a"], ["a"], [None]]
    assert rows_of(' "a"') == [[' "a"']]


def test_csv_limit_at_under_and_over(spark):
    files = spark.createDataFrame([("/a.csv", b"h\n1\n2\n3\n"), ("/b.csv", b'h\n"1\n\n\n"\n')], "path string, content binary")
    for limit, kept, more in ((3, 3, True), (4, 4, False), (5, 4, False), (None, 4, False)):
        rows = csv_cells(files, max_rows=limit).where("path = '/a.csv'").collect()
        assert len(rows) == kept and {r.truncated for r in rows} == {more}
    assert [(r.value, r.truncated) for r in csv_cells(files, max_rows=2).where("path = '/b.csv'").orderBy("row_idx").collect()] == [("h", False), ("1\n\n\n", False)]


def nested_tags(steps):
    """The stack of open lists, kept by hand."""
    stack, out = [], []
    for want, is_ul in steps:
        tags = ""
        while len(stack) > want:
            tags += f"</{stack.pop()}>"
        kind = "ul" if is_ul else "ol"
        if want and len(stack) == want and stack[-1] != kind:
            tags += f"</{stack.pop()}>"
        while len(stack) < want:
            stack.append(kind)
            tags += f"<{kind}>"
        out.append(tags)
    return out


def test_list_tags_against_a_stack(spark):
    rng = random.Random(5)
    docs = {str(d): [(rng.choice((0, 0, 1, 1, 2, 3, 5)), rng.random() < 0.5) for _ in range(60)] for d in range(12)} | {"flat": [(0, True)] * 3}
    rows = [(d, k, want, is_ul) for d, steps in docs.items() for k, (want, is_ul) in enumerate(steps)]
    got = list_tags(spark.createDataFrame(rows, "path string, seq int, want int, is_ul boolean")).collect()
    assert {(r.path, r.seq): r.tags for r in got} == {(d, k): tags for d, steps in docs.items() for k, tags in enumerate(nested_tags(steps))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(max_size=8), min_size=1, max_size=4), min_size=1, max_size=5))
def test_csv_round_trip(rows):
    quoted = "".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in rows)
    assert rows_of(quoted) == rows


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_markdown_never_leaves_tags_open(text):
    html = to_html(text)
    for tag in ("p", "ul", "ol", "li", "blockquote", "table", "em", "strong", "a", "h1"):
        assert html.count(f"<{tag}>") + html.count(f"<{tag} ") == html.count(f"</{tag}>")
    assert "<script" not in html


def test_markdown_spans():
    cases = {
        "***a***": "<em><strong>a</strong></em>", "**a *b* c**": "<strong>a <em>b</em> c</strong>", "a_b_c __d__": "a_b_c <strong>d</strong>", "*a **b*": "*a *<em>b</em>", "** a**": "** a**", "2 * 3 * 4": "2 * 3 * 4",
        "~~x~~ ~y~ ~~~z~~~": "<del>x</del> <del>y</del> ~~~z~~~", "`` a`b `` `c": "<code>a`b</code> `c", "`*a*`": "<code>*a*</code>", "\\*a*": "*a*", "[a *b](c) d*": '<a href="c">a *b</a> d*', "[a [b](c)](d)": '[a <a href="c">b</a>](d)',
        "![a **b**](c 'd')": '<img src="c" alt="a b" title="d">', "[x](<y>)": '<a href="y">x</a>', "[x]": "[x]", "&copy; &lt; &nothing;": "© &lt; &amp;nothing;", "<https://a.b/?c&d>": '<a href="https://a.b/?c&amp;d">https://a.b/?c&amp;d</a>', "see www.a.b/_c_.": 'see <a href="http://www.a.b/_c_">www.a.b/_c_</a>.',
    }
    assert {k: inline(k) for k in cases} == cases


def test_markdown_takes_odd_texts_in_linear_time():
    n = 20_000
    odd = [">" * n, "- " * n, "**a " * n, "*a _b " * n, " ".join("`" * (k % 50 + 1) for k in range(n)), "[" * n + "](b)" * n, "# " + " " * n + "x", "---" + " " * n + "x", "![" * n + "](a)" * n, "<http:" * n, "www." * n, "[x](" * n, "&#" * n, "|" * n + "\n" + "-|" * n]
    began = time.perf_counter()
    for text in odd:
        to_html(text)
    assert time.perf_counter() - began < 30
    assert to_html("> " * (MAX_NESTING + 3) + "x").count("<blockquote>") == MAX_NESTING


def test_rich_text_corner_cases():
    said = lambda data: "".join(t for _, k, t, _ in runs(data) if k == "text")
    assert said(rb"{\rtf1 \u233\'e9 \u8364 ?\'80x}") == "éé €€x"
    assert said(rb"{\rtf1 {\info hidden}{\*\unknown leaks}\\\{\}}") == "leaks\\{}"
    assert said(b"") == "" and said(b"}}}x") == "x" and said(b"{\\b") == ""
    paras = {p: s for p, _, _, s in runs(rb"a{\b b}\par c")}
    assert sorted(paras) == [0, 1] and paras[1] == (False, False, False)


def test_serial_matches_calendar(apply):
    days = [1, 60, 25569, 36526, 60000]
    assert apply(lambda c: X.serial_text(c, F.lit("date")), [float(d) for d in days], "double") == [str(datetime.date(1899, 12, 30) + datetime.timedelta(d)) for d in days]
