"""Raster decoders, settings, listings as pages, and the SQL functions."""

import struct
import zlib

import numpy as np

from folio.functions.register import register
from folio.operators.raster import to_png
from folio.plans.render import render_listing
from folio.sources.listing import read_listing
from folio.sources.settings import read_settings
from tests import samples


def pixels(png):
    width, height, _, kind = struct.unpack(">IIBB", png[16:26])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    raw = zlib.decompress(png[41 : 41 + struct.unpack(">I", png[33:37])[0]])
    return np.frombuffer(raw, np.uint8).reshape(height, 1 + width * channels)[:, 1:].reshape(height, width, channels).tolist()


RED, GREEN = [255, 0, 0], [0, 255, 0]


def test_rasters():
    assert pixels(to_png(b"P6\n# note\n2 1\n255\n\xff\0\0\0\xff\0")) == [[RED, GREEN]]
    assert pixels(to_png(b"P5 1 2 65535 \xff\xff\x00\x00")) == [[[255]], [[0]]]
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 1, 2, 24, 0)
    assert pixels(to_png(head + b"\0\xff\0\0\0\xff")) == [[RED], [GREEN]]  # from the bottom up
    rle = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 3, 1, 24, 0x20)
    assert pixels(to_png(rle + b"\x81\0\0\xff\x00\0\xff\0")) == [[RED, RED, GREEN]]
    psd = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 3, 1, 2, 8, 3) + b"\0" * 12
    assert pixels(to_png(psd + b"\0\0" + b"\xff\0" + b"\0\xff" + b"\0\0")) == [[RED, GREEN]]
    packed = psd + b"\0\x01" + struct.pack(">3H", 3, 3, 2) + b"\x01\xff\0" + b"\x01\0\xff" + b"\xff\0"
    assert pixels(to_png(packed)) == [[RED, GREEN]]
    hdr = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 2\n" + b"\x80\0\0\x81" + b"\0\x80\0\x81"
    assert pixels(to_png(hdr)) == [[RED, GREEN]]
    assert [to_png(x) for x in (b"", None, b"P6 broken", b"8BPS", b"#?", b"\0" * 18)] == [None] * 6


def test_settings(spark, tmp_path):
    (tmp_path / "rc").write_text("# all\nwidth = 900 # px\nwatch=Yes\nbad line\nwidth=800\nwidth=199\nheight=10001\n = x\n")
    assert sorted(tuple(r) for r in read_settings(spark, str(tmp_path / "rc")).collect()) == [("watch", "Yes", True, None), ("width", "800", False, 800)]


def test_listing_page(spark, tmp_path):
    (tmp_path / "a<b.md").write_text("x")
    (tmp_path / "sub").mkdir()
    html = render_listing(read_listing(spark, tmp_path)).first().html
    assert html.index('class="dir"') < html.index("sub/") < html.index("a&lt;b.md") and "../" in html and "1 B" in html


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(samples.tide_log(), samples.RTF, "a;b\n1;2")], "d binary, r binary, c string").createOrReplaceTempView("f")
    assert spark.sql("SELECT count(*) FROM f, LATERAL csv_cells(c, ';')").first()[0] == 4
    assert spark.sql("SELECT max(bold) FROM f, LATERAL rtf_runs(r)").first()[0]
    assert spark.sql("SELECT count(*) FROM f, LATERAL doc_parts(d, 'word/.*')").first()[0] == 5
    assert spark.sql("SELECT count(*) FROM f, LATERAL doc_nodes(d, 'word/document.xml') WHERE name = 'w:p' AND ev = 'start'").first()[0] > 10
    assert spark.sql("SELECT safe_link('https://x'), safe_link(' java\tscript:x'), json_reindent('[]'), xml_decode('&#65;')").first()[:] == (True, False, "[]", "A")
