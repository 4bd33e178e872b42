"""Softimage PIC: channel packets of all kinds, odd files, and the way through the renderer."""

import random
import struct

import numpy as np
import pytest

from folio.operators.raster import softimage, to_png
from folio.plans.render import render


def row_packed(values, how, rnd):
    """A row of pixels (bytes each) packed in one of the three ways."""
    if how == 0:
        return b"".join(values)
    out, at = b"", 0
    while at < len(values):
        run = next((n for n in range(1, len(values) - at + 1) if at + n == len(values) or values[at + n] != values[at]), 1)
        if how == 1:
            run = min(run, 255)
            out, at = out + bytes([run]) + values[at], at + run
        elif run > 128 or (run > 1 and rnd.random() < 0.2):
            out, at = out + b"\x80" + struct.pack(">H", run) + values[at], at + run
        elif run > 1:
            out, at = out + bytes([run + 127]) + values[at], at + run
        else:
            n = min(rnd.randrange(1, 4), len(values) - at)
            out, at = out + bytes([n - 1]) + b"".join(values[at : at + n]), at + n
    return out


def pic(pixels, packets, rnd):
    """``packets``: (how, channels)."""
    height, width, _ = pixels.shape
    head = b"\x53\x80\xf6\x34" + struct.pack(">f", 3.7) + b"made here".ljust(80, b"\0") + b"PICT" + struct.pack(">HHfHH", width, height, 1.0, 3, 0)
    head += b"".join(bytes([k + 1 < len(packets), 8, how, sum(0x80 >> c for c in channels)]) for k, (how, channels) in enumerate(packets))
    return head + b"".join(row_packed([bytes(p[c] for c in channels) for p in row.tolist()], how, rnd) for row in pixels for how, channels in packets)


@pytest.mark.parametrize("packets", [[(0, [0, 1, 2])], [(1, [0, 1, 2]), (2, [3])], [(2, [0, 1, 2, 3])], [(2, [0]), (1, [1, 2])]])
def test_packets(packets):
    rnd, rng = random.Random(1), np.random.default_rng(2)
    pixels = np.repeat(rng.integers(0, 256, (5, 60, 4), dtype=np.uint8), rng.integers(1, 20, 60), axis=1)
    got = softimage(pic(pixels, packets, rnd))
    channels = 4 if any(3 in c for _, c in packets) else 3
    assert (got == pixels[..., :channels]).all()
    wide = np.full((1, 700, 4), 9, np.uint8)
    assert (softimage(pic(wide, packets, rnd)) == wide[..., :channels]).all()


def test_odd_files_are_no_pictures(spark):
    rnd = random.Random(4)
    good = pic(np.zeros((2, 3, 4), np.uint8), [(2, [0, 1, 2])], rnd)
    assert to_png(good)[:8] == b"\x89PNG\r\n\x1a\n"
    assert [to_png(x) for x in (good[:-1], good[:100], good.replace(b"PICT", b"PICX"), good[:105] + b"\x10" + good[106:])] == [None] * 4
    for _ in range(500):
        raw = bytearray(good)
        raw[rnd.randrange(92, len(raw))] = rnd.randrange(256)
        to_png(bytes(raw))
    rows = {r.path: r for r in render(spark.createDataFrame([("/a.pic", good), ("/b.pic", good[:100])], "path string, content binary")).collect()}
    assert "data:image/png;base64," in rows["/a.pic"].html and rows["/a.pic"].error_message is None and rows["/b.pic"].error_message
