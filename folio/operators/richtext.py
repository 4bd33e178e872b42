"""Rich text (RTF) as runs.

The reader keeps the stack of groups and their formatting and gives a row per run; the
tags between runs come from comparing each run with the one before it in a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import escape_html
from folio.operators.office import TAB
from folio.operators.rows import expand

# Destinations that hold no text, and cp1252 as far as it differs from Latin-1.
SKIPPED = frozenset("fonttbl colortbl stylesheet info pict header footer footnote field object themedata datastore generator listtable revtbl".split())
CP1252 = dict(zip((*range(0x80, 0xA0),), "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ", strict=True))
MAX_DEPTH = 256

RUNS = "path string, seq int, para int, kind string, text string, bold boolean, italic boolean, underline boolean"
_TOKEN = re.compile(rb"[{}]|\\([A-Za-z]+)(-?[0-9]+)? ?|\\'(.?.?)|\\(.)|\\$|[\r\n]+|[^{}\\\r\n]+", re.S)


def runs(data: bytes) -> Iterator[tuple[int, str, str, tuple[bool, bool, bool]]]:
    """Paragraph, kind (text, br, tab, nbsp), text and formatting of each run; never fails."""
    style, stack, skip, fallback, para, used, left = (False, False, False), [], None, 1, 0, False, 0
    for m in _TOKEN.finditer(data):
        token, word, number, code, symbol = m[0], (m[1] or b"").decode(), m[2], m[3], m[4]
        said: tuple[str, str] | None = None
        if left and token[:1] not in b"\\{}":
            cut = min(left, len(token))
            token, left = token[cut:], 0
            if not token:
                continue
        left = 0
        if token == b"{":
            stack.append(style)
        elif token == b"}":
            style = stack.pop() if stack else style
            skip = None if skip is not None and len(stack) < skip else skip
        elif word == "u" and number is not None:
            point = int(number) + 65536 * (int(number) < 0)
            said = ("text", chr(point)) if 0 < point <= 0x10FFFF and not 0xD800 <= point < 0xE000 else None
            left = fallback
        elif word:
            if skip is not None:
                continue
            on = number is None or int(number) != 0
            if word == "par":
                para, used = para + used, False
            elif word in ("line", "tab"):
                said = ("br" if word == "line" else "tab", "")
            elif word in ("b", "i", "ul"):
                k = ("b", "i", "ul").index(word)
                style = (*style[:k], on, *style[k + 1 :])
            elif word == "ulnone":
                style = (*style[:2], False)
            elif word == "plain":
                style = (False, False, False)
            elif word == "uc":
                fallback = int(number) if number is not None else 1
            elif word in SKIPPED:
                skip = len(stack)
        elif code is not None:
            digits = code.decode("latin-1")
            value = int(digits, 16) if re.fullmatch("[0-9A-Fa-f]{2}", digits) else 0
            said = ("text", CP1252.get(value, chr(value)))
        elif symbol is not None:
            if symbol in b"\\{}":
                said = ("text", symbol.decode())
            elif symbol == b"~":
                said = ("nbsp", "")
            elif symbol in b"\r\n" and skip is None:
                para, used = para + used, False
        elif token[:1] not in b"\r\n\\":
            said = ("text", token.decode("utf-8", "replace"))
        if said and skip is None:
            used = True
            yield para, *said, style


def rtf_runs(files: DataFrame) -> DataFrame:
    """A row per run of ``path, content`` rows."""

    def read(row: dict) -> Iterator[tuple]:
        for seq, (para, kind, text, style) in enumerate(runs(row["content"] or b"")):
            yield row["path"], seq, para, kind, text, *style

    return expand(files.select("path", "content"), read, RUNS)


def rtf_pieces(files: DataFrame) -> DataFrame:
    """The runs as HTML: tags close (u, i, b) and open (b, i, u) where formatting changes."""
    w = Window.partitionBy("path", "para").orderBy("seq")
    was = lambda name: F.coalesce(F.lag(name).over(w), F.lit(False))
    tags = (("u", "underline"), ("i", "italic"), ("b", "bold"))
    closing = [F.when(was(c) & ~F.col(c), f"</{t}>").otherwise("") for t, c in tags]
    opening = [F.when(~was(c) & F.col(c), f"<{t}>").otherwise("") for t, c in reversed(tags)]
    last = F.lead("seq").over(w).isNull()
    ends = [F.when(last & F.col(c), f"</{t}>").otherwise("") for t, c in tags]
    said: Column = F.when(F.col("kind") == "br", "<br>").when(F.col("kind") == "tab", TAB).when(F.col("kind") == "nbsp", "&nbsp;").otherwise(escape_html(F.col("text")))
    html = F.concat(F.when(F.lag("seq").over(w).isNull(), "<p>").otherwise(""), *closing, *opening, said, *ends, F.when(last, "</p>").otherwise(""))
    return rtf_runs(files).select("path", "seq", "kind", html.alias("html"))
