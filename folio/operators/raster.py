"""Raster formats that browsers don't show, decoded and packed as PNG.

Binary PNM, Targa, the merged image of Photoshop files (8 or 16 bits, grey or RGB),
Radiance HDR and Softimage PIC. What can't be decoded gives null.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 2**31 - 1


def png(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x channels (1 to 4) bytes."""
    height, width, channels = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _fits(width: int, height: int) -> None:
    if not (0 < width and 0 < height and width * height * 4 <= MAX_BYTES):
        raise ValueError("size")


def pnm(data: bytes) -> np.ndarray:
    m = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    kind, width, height, most = (int(x) for x in m.groups())
    _fits(width, height)
    channels = 3 if kind == 6 else 1
    pixels = np.frombuffer(data, ">u2" if most > 255 else np.uint8, width * height * channels, m.end())
    return (pixels.astype(np.uint32) * 255 // max(1, most)).astype(np.uint8).reshape(height, width, channels)


def targa(data: bytes) -> np.ndarray:
    skip, mapped, kind, first, length, map_bits, _, _, width, height, bits, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    _fits(width, height)
    at = 18 + skip

    def colours(raw: np.ndarray, depth: int) -> np.ndarray:
        if depth in (15, 16):
            v = raw.view("<u2").astype(np.uint32)
            return np.stack([((v >> s) & 31) * 255 // 31 for s in (10, 5, 0)], axis=-1).reshape(-1, 3).astype(np.uint8)
        v = raw.reshape(-1, depth // 8)
        return v if depth == 8 else v[:, [2, 1, 0, 3][: depth // 8]]

    palette = None
    if mapped:
        size = length * ((map_bits + 7) // 8)
        palette, at = colours(np.frombuffer(data, np.uint8, size, at), map_bits), at + size
    step, need = (bits + 7) // 8, width * height
    if kind & 8:
        out, n = [], 0
        while n < need:
            count = (data[at] & 127) + 1
            if data[at] & 128:
                out.append(data[at + 1 : at + 1 + step] * count)
                at += 1 + step
            else:
                out.append(data[at + 1 : at + 1 + step * count])
                at += 1 + step * count
            n += count
        raw = np.frombuffer(b"".join(out), np.uint8)[: need * step]
    else:
        raw = np.frombuffer(data, np.uint8, need * step, at)
    pixels = palette[raw.astype(int) - first] if kind & 7 == 1 and palette is not None else colours(raw, bits)
    pixels = pixels.reshape(height, width, -1)
    return pixels if flags & 0x20 else pixels[::-1]


def photoshop(data: bytes) -> np.ndarray:
    sign, version, channels, height, width, depth, mode = struct.unpack(">4sH6xHIIHH", data[:26])
    if sign != b"8BPS" or version != 1 or depth not in (8, 16) or mode not in (1, 3):
        raise ValueError("kind")
    _fits(width, height)
    at = 26
    for _ in range(3):  # colour data, resources, layers
        at += 4 + struct.unpack(">I", data[at : at + 4])[0]
    packed = struct.unpack(">H", data[at : at + 2])[0]
    at, shown = at + 2, min(channels, 4 if mode == 3 else 1)
    if packed == 1:
        sizes = np.frombuffer(data, ">u2", height * channels, at)
        at += 2 * height * channels
        planes = bytearray()
        for size in sizes[: height * shown]:
            end, row = at + int(size), bytearray()
            while at < end:
                n = data[at]
                row += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
                at += 2 + n if n < 128 else 2 if n > 128 else 1
            planes += row[: width * depth // 8].ljust(width * depth // 8, b"\0")
            at = end
        flat = np.frombuffer(bytes(planes), np.uint8)
    else:
        flat = np.frombuffer(data, np.uint8, height * width * shown * depth // 8, at)
    return np.moveaxis(flat[:: depth // 8].reshape(shown, height, width), 0, -1)


def radiance(data: bytes) -> np.ndarray:
    m = re.match(rb"#\?(?:RADIANCE|RGBE)\n.*?\n\n-Y (\d+) \+X (\d+)\n", data, re.S)
    height, width, at = int(m[1]), int(m[2]), m.end()
    _fits(width, height)
    if data[at : at + 2] == b"\x02\x02" and 8 <= width < 32768:
        rows = []
        for _ in range(height):
            at += 4
            for _ in range(4):
                row = bytearray()
                while len(row) < width:
                    n = data[at]
                    row += data[at + 1 : at + 2] * (n - 128) if n > 128 else data[at + 1 : at + 1 + n]
                    at += 2 if n > 128 else 1 + n
                rows.append(bytes(row[:width]))
        rgbe = np.moveaxis(np.frombuffer(b"".join(rows), np.uint8).reshape(height, 4, width), 1, -1)
    else:
        rgbe = np.frombuffer(data, np.uint8, height * width * 4, at).reshape(height, width, 4)
    light = rgbe[..., :3].astype(float) * np.where(rgbe[..., 3:] > 0, 2.0 ** (rgbe[..., 3:].astype(float) - 136), 0)
    return np.clip(light ** (1 / 2.2) * 255 + 0.5, 0, 255).astype(np.uint8)


def softimage(data: bytes) -> np.ndarray:
    """Rows by packets of channels, each packed its own way: as it is (0), as runs (1), or as runs and stretches (2)."""
    if data[88:92] != b"PICT":
        raise ValueError("kind")
    width, height = struct.unpack(">HH", data[92:96])
    _fits(width, height)
    packets, at, more = [], 104, True
    while more:
        more, size, how, mask = data[at : at + 4]
        at += 4
        if size != 8 or how > 2 or len(packets) == 8:
            raise ValueError("packet")
        packets.append((how, [k for k in range(4) if mask & 0x80 >> k]))
    pixels = np.zeros((height, width, 4), np.uint8)
    pixels[..., 3] = 255
    for y in range(height):
        for how, channels in packets:
            step, row = len(channels), bytearray()
            while len(row) < width * step:
                n, whole = (width, True) if how == 0 else (data[at], False) if how == 1 else (data[at] + 1, True) if data[at] < 128 else (data[at] - 127, False)
                at += how > 0
                if how == 2 and not whole and n == 1:  # a long run has its length in two bytes
                    n, at = struct.unpack(">H", data[at : at + 2])[0], at + 2
                part = data[at : at + step * (n if whole else 1)]
                if not part or not n:
                    raise ValueError("row")
                row += part if whole else part * n
                at += len(part)
            pixels[y][:, channels] = np.frombuffer(bytes(row[: width * step]), np.uint8).reshape(width, step)
    return pixels if any(3 in c for _, c in packets) else pixels[..., :3]


def to_png(data: bytes | None) -> bytes | None:
    if not data:
        return None
    read = pnm if data[:2] in (b"P5", b"P6") else photoshop if data[:4] == b"8BPS" else radiance if data[:2] == b"#?" else softimage if data[:4] == b"\x53\x80\xf6\x34" else targa
    try:
        return png(np.ascontiguousarray(read(data)))
    except Exception:  # whatever is wrong with it, the file can't be shown
        return None


@F.pandas_udf(T.BinaryType())
def raster_png(content: pd.Series) -> pd.Series:
    return content.map(to_png)
