"""Scalar functions over paths, links, text and numbers, as Column expressions.

Where Spark's own functions can't give the exact result (numeric character references,
``%g``), an Arrow UDF does.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- paths


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension: 1 to 15 characters of ``[a-z0-9_+-]``, or empty; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([A-Za-z0-9_+-]{1,15})$", 1))


def directory(path: Column) -> Column:
    """Up to the last slash, which it keeps."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def parent(path: Column) -> Column:
    """The folder above, null at the root."""
    bare = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    up = F.regexp_extract(bare, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((bare == "/") | (F.instr(bare, "/") == 0), F.lit(None)).when(up == "", F.lit("/")).otherwise(up)


# --- HTML and links


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def link_scheme(url: Column) -> Column:
    """The scheme with its colon, if it shows within 31 characters, without spaces and control characters."""
    return F.regexp_extract(F.lower(F.regexp_replace(url, r"[\x00-\x20\x7F]", "")), "^([^/?#:]{0,30}:)", 1)


def safe_link(url: Column) -> Column:
    """Whether a link is relative or has one of the allowed schemes."""
    return link_scheme(url).isin("", "http:", "https:", "mailto:")


def data_uri(mime: Column, content: Column) -> Column:
    """Base64 without line breaks, whatever the session's setting."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


_ENTITY = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([0-9]{1,9})|#[xX]([0-9A-Fa-f]{1,8}));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_entities(text: str | None) -> str | None:
    """One pass over the five named and all numeric references; others stay as they are."""

    def one(m: re.Match) -> str:
        if m[1]:
            return _NAMED[m[1]]
        code = int(m[2]) if m[2] else int(m[3], 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return None if text is None else _ENTITY.sub(one, text)


@F.pandas_udf(T.StringType())
def xml_decode(text: pd.Series) -> pd.Series:
    return text.map(decode_entities, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def xml_decode_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [decode_entities(t) for t in x], na_action="ignore")


# --- sizes, bytes and dumps


def human_size(size: Column) -> Column:
    """Bytes as they are; above, in steps of 1024 with one decimal, halves to even."""
    size = size.cast("long")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        step = F.lit(1024**k)
        tenths, rest = F.floor(size * 10 / step), F.pmod(size * 10, step)
        tenths = F.when((2 * rest > step) | ((2 * rest == step) & (F.pmod(tenths, F.lit(2)) == 1)), tenths + 1).otherwise(tenths)
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= step, shown).otherwise(out)
    return out


def hex_dump(content: Column, limit: int = 512) -> Column:
    """Offset, 16 bytes in hex (a wider gap in the middle) and printable ASCII per line; then a note of what is left."""
    head = F.substring(content, 1, limit)

    def line(at: Column) -> Column:
        part = F.substring(head, at + 1, F.lit(16))
        pairs = F.rpad(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "), 48, " ")
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
        spaced = F.concat(F.substring(pairs, 1, 24), F.lit(" "), F.substring(pairs, 25, 24))
        return F.concat(F.lpad(F.lower(F.hex(at)), 8, "0"), F.lit("  "), spaced, F.lit(" |"), shown, F.lit("|"))

    starts = F.when(F.length(head) > 0, F.sequence(F.lit(0), F.length(head) - 1, F.lit(16))).otherwise(F.array().cast("array<int>"))
    lines = F.array_join(F.transform(starts, line), "\n")
    more = F.length(content) - limit
    return F.when(more > 0, F.concat(lines, F.lit("\n... ("), more.cast("string"), F.lit(" more bytes)"))).otherwise(lines)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[^@-~]*[@-~]", "")


# --- JSON text

_JSON_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"?|[{\[](?:[ \t\n\r]*([}\]]))?|[}\]]|,|:|[ \t\n\r]+|[^"{}\[\],: \t\n\r]+', re.S)
_CLOSES = {"{": "}", "[": "]"}


def reindent(text: str | None, step: str = "  ") -> str | None:
    """JSON text with one token after another on indented lines; never fails, also on malformed text."""
    if text is None:
        return None
    depth, out, at = 0, [], 0
    while at < len(text):
        m = _JSON_TOKEN.match(text, at)
        token, at = m[0], m.end()
        first = token[0]
        if first in "{[":
            if m[1] == _CLOSES[first]:
                out.append(first + m[1])
                continue
            if m[1]:  # closed by the other bracket: that is a token of its own
                at = m.start() + 1
            depth += 1
            out.append(first + "\n" + step * depth)
        elif first in "}]":
            depth = max(0, depth - 1)
            out.append("\n" + step * depth + first)
        elif first == ",":
            out.append(",\n" + step * depth)
        elif first == ":":
            out.append(": ")
        elif first not in " \t\n\r":
            out.append(token)
    return "".join(out)


@F.pandas_udf(T.StringType())
def json_reindent(text: pd.Series) -> pd.Series:
    return text.map(reindent, na_action="ignore")


# --- numbers of spreadsheets


def leading_number(text: Column, whole: bool = False) -> Column:
    """The longest numeric prefix, else 0."""
    pattern = r"^\s*([+-]?[0-9]+)" if whole else r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long" if whole else "double"), F.lit(0))


def column_of_ref(ref: Column) -> Column:
    """The 0-based column of a cell reference (its first four capitals at most), -1 without capitals."""
    letters = F.regexp_extract(ref, "^[A-Z]{1,4}", 0)
    value = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))
    return F.when(letters == "", F.lit(-1)).otherwise(value - 1).cast("int")


def builtin_format(fmt: Column) -> Column:
    """The kind of a built-in number format."""
    return F.when(fmt.between(14, 17), "date").when(fmt == 22, "datetime").when(fmt.between(18, 21) | fmt.between(45, 47), "time").when(fmt.isin(9, 10), "percent").otherwise("general")


def custom_format(code: Column) -> Column:
    """The kind of a format code, by its letters outside of quotes, brackets and escapes."""
    bare = F.regexp_replace(F.regexp_replace(code, r'"[^"]*("|$)|\[[^\]]*(\]|$)|\\.?', ""), r"\\", "")
    date, time = bare.rlike("[yYdD]"), bare.rlike("[hHsS]")
    return F.when(bare.contains("%"), "percent").when(date & time, "datetime").when(date, "date").when(time, "time").otherwise("general")


def serial_text(serial: Column, kind: Column) -> Column:
    """A spreadsheet's day number as text; ``kind`` is date, datetime or time."""
    whole = F.floor(serial)
    total = whole * 86400 + F.floor((serial - whole) * 86400 + 0.5)

    def shown(seconds: Column) -> Column:
        date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
        hour, minute, second = (F.pmod(F.floor(seconds / n), F.lit(m)) for n, m in ((3600, 24), (60, 60), (1, 60)))
        return F.when(kind == "time", F.format_string("%02d:%02d:%02d", hour, minute, second)).when(kind == "datetime", F.concat(date, F.format_string(" %02d:%02d", hour, minute))).otherwise(date)

    # the lambda's variable stands for the seconds, which would be written out at every use otherwise
    return F.get(F.transform(F.array(total), shown), 0)


@F.pandas_udf(T.StringType())
def percent_text(value: pd.Series) -> pd.Series:
    """``%g`` of a hundredfold value, which Spark's format_string pads."""
    return value.map(lambda v: "%g%%" % (v * 100.0), na_action="ignore")
