"""Sizes of pictures whose headers lie in chunks or boxes: WebP, ICO and AVIF; and of SVG."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Size = tuple[int | None, int | None]
NONE: Size = (None, None)
#: Bytes in which an SVG's first tag must end, and how deep boxes are followed.
HEAD, DEPTH = 1 << 16, 8
#: Pixels of a unit.
UNITS = {"": 1, "px": 1, "pt": 4 / 3, "pc": 16, "in": 96, "cm": 96 / 2.54, "mm": 9.6 / 2.54}


def webp_size(d: bytes) -> Size:
    """Of the first chunk that tells it: extended, lossless or lossy."""
    at, little = 12, lambda a, n: int.from_bytes(d[a : a + n], "little")
    while at + 8 <= len(d):
        kind, body = d[at : at + 4], at + 8
        if kind == b"VP8X" and body + 10 <= len(d):
            return little(body + 4, 3) + 1, little(body + 7, 3) + 1
        if kind == b"VP8L" and d[body : body + 1] == b"\x2f" and body + 5 <= len(d):
            bits = little(body + 1, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 " and d[body + 3 : body + 6] == b"\x9d\x01\x2a" and body + 10 <= len(d):
            return little(body + 6, 2) & 0x3FFF, little(body + 8, 2) & 0x3FFF
        n = little(at + 4, 4)
        at = body + n + n % 2
    return NONE


def ico_size(d: bytes) -> Size:
    """Of the largest picture."""
    n = int.from_bytes(d[4:6], "little")
    sizes = [(d[k] or 256, d[k + 1] or 256) for k in range(6, min(6 + 16 * n, len(d) - 15), 16)]
    return max(sizes, key=lambda s: s[0] * s[1], default=NONE)


def boxes(d: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the contents of each box in a stretch."""
    while at + 8 <= end:
        size, kind, body = int.from_bytes(d[at : at + 4]), d[at + 4 : at + 8], at + 8
        if size == 1:
            size, body = int.from_bytes(d[at + 8 : at + 16]), at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            return
        yield kind, body, stop
        at = stop


def avif_size(d: bytes) -> Size:
    """Of the primary item by the properties that belong to it, turned as it is shown; else of the largest item."""
    primary, properties, owned = None, [], {}
    for kind, body, stop in boxes(d, 0, len(d)):
        if kind != b"meta":
            continue
        for kind, body, stop in boxes(d, body + 4, stop):  # noqa: PLW2901, B020
            if kind == b"pitm":
                primary = int.from_bytes(d[body + 4 : body + (6 if d[body] == 0 else 8)])
            elif kind == b"iprp":
                for inner, start, last in boxes(d, body, stop):
                    if inner == b"ipco":
                        properties = [(k, a) for k, a, _ in boxes(d, start, last)]
                    elif inner == b"ipma":
                        owned |= owners(d, start, last)
    size = lambda a: (int.from_bytes(d[a + 4 : a + 8]), int.from_bytes(d[a + 8 : a + 12]))
    mine = [properties[k - 1] for k in owned.get(primary, []) if 0 < k <= len(properties)]
    sizes = [size(a) for k, a in mine if k == b"ispe"] or [max((size(a) for k, a in properties if k == b"ispe"), key=lambda s: s[0] * s[1], default=NONE)]
    turned = any(k == b"irot" and d[a : a + 1] and d[a] % 2 for k, a in mine)
    return sizes[0][::-1] if turned else sizes[0]


def owners(d: bytes, at: int, end: int) -> dict[int, list[int]]:
    """Numbers of properties, from 1, of each item."""
    version, wide = d[at] if at < end else 0, d[at + 3] & 1 if at + 3 < end else 0
    n, at, made = int.from_bytes(d[at + 4 : at + 8]), at + 8, {}
    for _ in range(n):
        width = 2 if version == 0 else 4
        if at + width >= end:
            break
        item, k, at = int.from_bytes(d[at : at + width]), d[at + width], at + width + 1
        step = 2 if wide else 1
        made[item] = [int.from_bytes(d[a : a + step]) & (0x7FFF if wide else 0x7F) for a in range(at, min(at + k * step, end), step)]
        at += k * step
    return made


def svg_size(d: bytes) -> Size:
    """By the width and height of the first tag, what is missing by the proportions of its view; without a unit that has pixels none."""
    tag = re.search(r"<(?:\w+:)?svg\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.sub(r"<!--.*?(?:-->|$)", "", d[:HEAD].decode("utf-8", "replace"), flags=re.S))
    if not tag:
        return NONE
    said = {m[1]: m[2] if m[2] is not None else m[3] for m in re.finditer(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag[1])}

    def pixels(text: str) -> float | None:
        m = re.fullmatch(r"\s*(\d+\.?\d*|\.\d+)\s*([a-z]*)\s*", text)
        return float(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else None

    view = [float(x) for x in re.findall(r"-?(?:\d+\.?\d*|\.\d+)", said.get("viewBox", ""))]
    wide, tall = view[2:4] if len(view) == 4 and min(view[2:4]) > 0 else (None, None)
    w, h = pixels(said.get("width", "")), pixels(said.get("height", ""))
    if wide and tall:
        w, h = w if w is not None else h * wide / tall if h is not None else wide, h if h is not None else w * tall / wide if w is not None else tall
    return (round(w), round(h)) if w is not None and h is not None else NONE


def size_of(d: bytes | None) -> Size:
    if not d:
        return NONE
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        return webp_size(d)
    if d[:4] == b"\0\0\1\0":
        return ico_size(d)
    if d[4:8] == b"ftyp":
        return avif_size(d)
    return svg_size(d)


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def boxed_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size_of(x) for x in content], columns=["width", "height"]).astype("Int64")
