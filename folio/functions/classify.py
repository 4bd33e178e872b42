"""What kind of file it is: extension, then signature bytes, then a look at its bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.pictures import HEAD, boxed_size
from folio.functions.text import basename, extension

# Extensions by kind.
EXTENSIONS = {
    "markdown": "md markdown mdown mkd",
    "json": "json jsonl geojson",
    "notebook": "ipynb",
    "csv": "csv tsv",
    "image": "png jpg jpeg gif webp bmp svg ico avif",
    "raster": "tga psd hdr pnm ppm pgm pic",
    "html": "html htm xhtml",
    "pdf": "pdf",
    "docx": "docx",
    "pptx": "pptx",
    "xlsx": "xlsx",
    "opendocument": "odt ods odp",
    "rtf": "rtf",
    "text": "txt log c h cc cpp hpp py rb rs go js ts jsx tsx java kt swift sh bash zsh yaml yml toml ini cfg conf xml sql diff patch tex m mm lua pl php cs scala hs el vim zig d r mk cmake gradle",
}
#: Kinds that binary-looking content overrides.
TEXT_FAMILY = ("text", "markdown", "json", "csv")
HEAD = 8192


def kind_of_extension(ext: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kind, names in EXTENSIONS.items() for name in names.split() for x in (name, kind)))
    return F.try_element_at(kinds, ext)


def starts(content: Column, signature: bytes) -> Column:
    return F.substring(content, 1, len(signature)) == F.lit(signature)


def kind_of_bytes(content: Column) -> Column:
    """By signature, null if none fits. ZIP containers tell by a member's name anywhere in them."""
    holds = lambda name: F.contains(content, F.lit(name.encode()))
    container = F.when(holds("word/document.xml"), "docx").when(holds("ppt/presentation.xml"), "pptx").when(holds("xl/workbook.xml"), "xlsx").when(holds("vnd.oasis.opendocument"), "opendocument")
    webp = starts(content, b"RIFF") & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    picture = starts(content, b"\x89PNG\r\n\x1a\n") | starts(content, b"\xff\xd8\xff") | starts(content, b"GIF87a") | starts(content, b"GIF89a") | webp | (starts(content, b"BM") & (F.length(content) > 26))
    return F.when(starts(content, b"%PDF-"), "pdf").when(starts(content, b"{\\rtf"), "rtf").when(picture, "image").when(starts(content, b"PK\x03\x04"), container)


def looks_like_text(content: Column) -> Column:
    """In the first 8,192 bytes no zero, and under 5 % other control bytes than tab, line feeds, form feed and escape."""
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0B\x0E-\x1A\x1C-\x1F]", ""))
    return (F.length(head) == 0) | (~F.contains(head, F.lit("\x00")) & (odd * 20 < F.length(head)))


def detect(path: Column, content: Column) -> Column:
    """The file's kind. Only claims of the text family are checked against the bytes."""
    by_name, by_bytes, is_text = kind_of_extension(extension(path)), kind_of_bytes(content), looks_like_text(content)
    first = F.coalesce(by_name, by_bytes, F.when(is_text, "text").otherwise("binary"))
    return F.when(first.isin(*TEXT_FAMILY) & ~is_text, F.coalesce(by_bytes, F.lit("binary"))).otherwise(first)


def language(path: Column) -> Column:
    """The language for highlighting, null if unknown."""
    base = basename(path)
    return F.when(base.isin("Makefile", "makefile", "GNUmakefile"), "makefile").when(base == "Dockerfile", "dockerfile").when(base == "CMakeLists.txt", "cmake").otherwise(F.nullif(extension(path), F.lit("")))


def image_mime(content: Column, ext: Column) -> Column:
    """Of an image file: by signature, then for some formats by extension."""
    by_name = F.when(ext == "svg", "image/svg+xml").when(ext == "ico", "image/x-icon").when(ext == "avif", "image/avif").when(ext.isin("jpg", "jpeg"), "image/jpeg")
    webp = starts(content, b"RIFF") & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    return F.coalesce(
        F.when(starts(content, b"\x89PNG\r\n\x1a\n"), "image/png").when(starts(content, b"\xff\xd8\xff"), "image/jpeg").when(starts(content, b"GIF87a") | starts(content, b"GIF89a"), "image/gif").when(webp, "image/webp").when(starts(content, b"BM"), "image/bmp"),
        by_name,
        F.lit("application/octet-stream"),
    )


def _whole(content: Column, at: int, n: int, little: bool = False) -> Column:
    """The unsigned integer of n bytes at a place, from 1."""
    places = range(at, at + n) if not little else range(at + n - 1, at - 1, -1)
    return F.conv(F.hex(F.concat(*(F.substring(content, k, 1) for k in places))), 16, 10).cast("long")


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Of the frame header of a JPEG; the segments before it are stepped over."""

    def one(data: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while data is not None and at + 9 <= len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
            at += 1 if data[at + 1] == 0xFF else 2 + int.from_bytes(data[at + 2 : at + 4])
        return None, None

    return pd.DataFrame([one(x) for x in content], columns=["width", "height"]).astype("Int64")


def image_size(content: Column) -> Column:
    """``width, height`` of PNG, GIF, BMP, JPEG, WebP, ICO, AVIF and SVG images, null for others; the first three stay in the JVM."""
    looks_boxed = (starts(content, b"RIFF") & (F.substring(content, 9, 4) == F.lit(b"WEBP"))) | starts(content, b"\0\0\1\0") | (F.substring(content, 5, 4) == F.lit(b"ftyp")) | F.contains(F.substring(content, 1, HEAD), F.lit(b"<svg")) | F.contains(F.substring(content, 1, HEAD), F.lit(b":svg"))
    boxed = boxed_size(F.when(looks_boxed, content))
    jpeg = jpeg_size(F.when(starts(content, b"\xff\xd8\xff"), content))
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    tall = _whole(content, 23, 4, True)
    up = F.when(tall >= 2**31, 2**32 - tall).otherwise(tall)  # rows from the top have a negative height
    known = F.when(starts(content, b"\x89PNG\r\n\x1a\n"), size(_whole(content, 17, 4), _whole(content, 21, 4))).when(starts(content, b"GIF8"), size(_whole(content, 7, 2, True), _whole(content, 9, 2, True))).when(starts(content, b"BM"), size(_whole(content, 19, 4, True), up))
    return F.coalesce(known, F.when(jpeg["width"].isNotNull(), jpeg), F.when(boxed["width"].isNotNull(), boxed))


def part_mime(content: Column, name: Column, dialect: str) -> Column:
    """Of an image inside a document; null where that document's readers show none."""
    mime = F.when(starts(content, b"\x89PNG\r\n\x1a\n"), "image/png").when(starts(content, b"\xff\xd8\xff"), "image/jpeg").when(starts(content, b"GIF8"), "image/gif")
    if dialect != "odf":
        mime = mime.when(starts(content, b"BM"), "image/bmp")
    if dialect in ("docx", "odf"):
        mime = mime.when(name.endswith(".svg"), "image/svg+xml")
    return mime.otherwise("application/octet-stream") if dialect == "odf" else mime


def classify(files: DataFrame) -> DataFrame:
    """Adds ``file_type``, ``ext`` and ``language`` to ``path, content`` rows."""
    return files.withColumns({"ext": extension(F.col("path")), "file_type": detect(F.col("path"), F.col("content")), "language": language(F.col("path"))})
