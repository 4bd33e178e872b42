"""PDF files: what they tell of themselves, and the text and links of their pages.

A reader goes once over a file and gives rows: its pages with their sizes, links, and runs of text
with their places, in the order in which they are drawn. A row holds a page's runs, or so many of them, as
arrays; lines are put together by expressions over these, and pages from their rows by an aggregation.
"""

from __future__ import annotations

import bisect
import codecs
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.pdf_objects import BUDGET, WHITE, Damaged, Name, Op, Pdf, Ref, Stream, TooLarge, from_hex, tokens
from folio.operators.rows import expand, joined

MAX_PAGES = 200
#: Forms drawn within each other.
FORMS = 8
#: Runs in a row of a page, about, and what a row is: the file (``page`` is the number of pages, ``fault`` what is wrong) or, from the
#: page's ``start`` on, its facts and links (in its first row), its runs, a fault (in its last), and what the run before was like.
RUNS = 10_000
PAGES = (
    "path string, kind string, page int, start int, width double, height double, rotation double, fault string, link_x array<double>, link_y array<double>, targets array<string>,"
    "x array<double>, y array<double>, size array<double>, across array<double>, text array<string>, last_end double, last_y double, last_space boolean"
)
NO_LINKS, NO_RUNS, NOTHING = ((),) * 3, ((),) * 5, (None,) * 3
ROWS = "path string, kind string, page int, seq int, x double, y double, size double, width double, text string"
PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
IN_LINE_END = re.compile(rb"[\s]EI(?=[\s]|$)")
OBJECTS = re.compile(rb"/ObjStm\b[^>]*>>\s*stream\r?\n")
TELL = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("partial", T.BooleanType())])

#: Most of what pages hold, read in one go: an operator after numbers alone, or one that draws a string or an array of strings and steps.
#: What this leaves out (names, dictionaries, escapes, pictures in line, references, comments) goes by ``tokens``.
_SPACE, _END, _NUMBER = rb"[%s]" % WHITE, rb"[%s/<>\[\](){}%%]" % WHITE, rb"[+-]?(?:\d+\.?\d*|\.\d+)"
_HEX = rb"<[0-9A-Fa-f%s]*+>" % WHITE
INSTRUCTION = re.compile(
    rb"%(s)s*+(?:((?:%(n)s%(s)s++)*+)(?!(?:true|false|null|ID)(?:%(e)s|$)|R(?![A-Za-z0-9]))([A-Za-z'\"][^%(not_e)s]*+)|(?:<([0-9A-Fa-f%(w)s]*+)>|\(([^()\\]*+)\))%(s)s*+Tj(?=%(e)s|$)|\[((?:%(s)s++|%(h)s|%(n)s(?=%(e)s))*+)\]%(s)s*+TJ(?=%(e)s|$))"
    % {b"s": _SPACE, b"n": _NUMBER, b"e": _END, b"not_e": _END[1:-1], b"h": _HEX, b"w": WHITE}
)
PARTS = re.compile(rb"<([^>]*)>|([+-]?[0-9.]+)")
#: Strings with a step after each, and steps between them, up to a thousand at a time.
STRETCH = re.compile(rb"(?:(?:%(s)s*+%(h)s%(s)s*+Tj(?=%(s)s))?+%(s)s*+%(n)s%(s)s++%(n)s%(s)s++Td(?=%(e)s|$)){1,1000}+" % {b"s": _SPACE, b"n": _NUMBER, b"e": _END, b"h": _HEX})
STEPPED = re.compile(rb"(?:<([^>]*)>%(s)s*+Tj%(s)s++)?+(%(n)s)%(s)s++(%(n)s)%(s)s++Td" % {b"s": _SPACE, b"n": _NUMBER})
#: What ``instructions`` gives for them, for a string and for an array of strings as written, when asked for.
STEPS, DIGITS, ARRAY = b"<>", b"<", b"["
#: Fonts that files share, ways of spacing whose steps a font keeps, and codes and strings (of so many bytes at most) that all of these keep together.
FONTS, PACES, KEPT, SHORT = 64, 16, 1 << 16, 64

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

# Glyph names that follow from no rule.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "Euro": "€", "copyright": "©", "registered": "®", "degree": "°", "section": "§",
}


def glyph(name: str) -> str:
    base = name.partition(".")[0]
    if base in GLYPHS or len(base) == 1:
        return GLYPHS.get(base, base)
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", base):
        code = int(m[1][:4] if base.startswith("uni") else m[1], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    m = re.fullmatch(rf"(dotlessi|[A-Za-z])({'|'.join(ACCENTS)})", base)
    return unicodedata.normalize("NFC", m[1][-1] + ACCENTS[m[2]]) if m else "�"


class CMap:
    """What codes mean, as ranges: (first, last, UTF-16 of the first), or one value a code."""

    def __init__(self, data: bytes):
        self.ranges: list[tuple[int, int, list[bytes]]] = []
        self.code_bytes = 0
        held: list = []
        for value, _ in tokens(data):
            if not isinstance(value, Op):
                held.append(value)
                continue
            if value == b"endcodespacerange":
                self.code_bytes = max([self.code_bytes, *(len(x) for x in held if isinstance(x, bytes))])
            elif value in (b"endbfchar", b"endbfrange"):
                step = 2 if value == b"endbfchar" else 3
                for k in range(0, len(held) - step + 1, step):
                    first, last, to = held[k], held[k + step - 2], held[k + step - 1]
                    if isinstance(first, bytes) and isinstance(last, bytes):
                        to = [x for x in to if isinstance(x, bytes)] if isinstance(to, list) else [to]
                        self.ranges.append((int.from_bytes(first), int.from_bytes(last), to))
            held = []
        self.ranges.sort(key=lambda r: r[0])
        self.firsts = [r[0] for r in self.ranges]

    def meaning(self, code: int) -> bytes | None:
        k = bisect.bisect_right(self.firsts, code) - 1
        if k < 0 or code > self.ranges[k][1]:
            return None
        first, _, to = self.ranges[k]
        if len(to) > 1:
            return to[code - first] if code - first < len(to) else None
        if not to or not isinstance(to[0], bytes):
            return None
        return (int.from_bytes(to[0]) + code - first).to_bytes(len(to[0]) + 1)[1:]


class Fonts:
    """Fonts by what they are, for files with equal ones, and what has been read by them; when there is too much, all of it goes."""

    def __init__(self) -> None:
        self.found: dict[str, Font] = {}
        self.kept: list[Kept] = []
        self.n = 0

    def font(self, pdf: Pdf, about: dict) -> Font:
        get = pdf.get

        def told(value: object, depth: int = 0) -> object:
            value = get(value)
            if depth > 4:
                raise RecursionError
            if isinstance(value, Stream):
                return "stream"
            if isinstance(value, dict):
                return {k: told(v, depth + 1) for k, v in value.items()}
            return [told(v, depth + 1) for v in value] if isinstance(value, list) else value

        cmap = pdf.content(stream) if isinstance(stream := get(about.get("ToUnicode")), Stream) else None
        under = (get(about.get("DescendantFonts")) or [None])[0]
        try:
            key = repr([[told(of.get(k)) for k in ks] for of, ks in ((about, ("Subtype", "FirstChar", "Widths", "Encoding")), (get(under, {}), ("DW", "W")))] + [cmap])
        except RecursionError:
            return Font(pdf, about, cmap, self)
        if key not in self.found:
            if len(self.found) >= FONTS:
                self.drop()
            self.found[key] = Font(pdf, about, cmap, self)
        return self.found[key]

    def drop(self) -> None:
        for kept in self.kept:
            kept.clear()
        self.found, self.kept, self.n = {}, [], 0


class Kept(dict):
    """What is made of keys that are asked for."""

    def __init__(self, fonts: Fonts, make: Callable):
        super().__init__()
        self._fonts, self._make = fonts, make

    def __missing__(self, key: object) -> object:
        made = self._make(key)
        if not isinstance(key, bytes) or len(key) <= SHORT:
            if self._fonts.n >= KEPT:
                self._fonts.drop()
            if not self:
                self._fonts.kept.append(self)
            self[key] = made
            self._fonts.n += 1
        return made


class Font:
    """How a font's codes read and how far they go (thousandths of its size)."""

    def __init__(self, pdf: Pdf, about: dict, cmap: bytes | None, fonts: Fonts):
        get = pdf.get
        self.fonts, self.texts = fonts, Kept(fonts, self.read)
        self.wide = get(about.get("Subtype")) == "Type0"
        self.widths: dict[int, float] = {}
        self.usual = 500.0
        under = get((get(about.get("DescendantFonts")) or [None])[0], {}) if self.wide else {}
        if self.wide:
            self.usual = float(get(under.get("DW"), 1000))
            self._cid_widths([get(x) for x in get(under.get("W"), [])], get)
        else:
            first = get(about.get("FirstChar"), 0)
            self.widths = {first + k: float(w) for k, w in enumerate(map(get, get(about.get("Widths"), []))) if isinstance(w, (int, float))}
        self.cmap = CMap(cmap) if cmap is not None else None
        encoding = get(about.get("Encoding"))
        base = get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.names: dict[int, str] = {}
        at = 0
        for x in get(encoding.get("Differences"), []) if isinstance(encoding, dict) else []:
            if isinstance(x, Name):
                self.names[at] = x
                at += 1
            elif isinstance(x, int):
                at = x
        self.code_bytes = (self.cmap.code_bytes if self.cmap else 0) or 2 if self.wide else 1
        self.paces: dict[tuple, Pace] = {}

    def _cid_widths(self, w: list, get) -> None:
        k = 0
        while k + 1 < len(w):
            if isinstance(w[k + 1], list):
                self.widths |= {w[k] + n: float(get(x)) for n, x in enumerate(w[k + 1])}
                k += 2
            else:
                if k + 2 < len(w) and w[k + 1] - w[k] <= 0xFFFF:
                    self.widths |= dict.fromkeys(range(w[k], w[k + 1] + 1), float(w[k + 2]))
                k += 3

    def read(self, code: int) -> bytes:
        """UTF-16 of a code."""
        said = self.cmap.meaning(code) if self.cmap else None
        if said is None:
            if self.wide:
                text = "�"
            elif code in self.names:
                text = glyph(self.names[code])
            else:
                text = bytes([code]).decode(self.codec, "replace")
            said = text.encode("utf-16-be", "surrogatepass")
        return said

    def codes(self, raw: bytes) -> Iterable[int]:
        n = self.code_bytes
        if n == 2 and len(raw) % 2 == 0:
            return struct.unpack(f">{len(raw) // 2}H", raw)
        return raw if n == 1 else [int.from_bytes(raw[k : k + n]) for k in range(0, len(raw), n)]

    def pace(self, *how: float) -> Pace:
        """Text and step of each code for a size, letter and word spacing and scale."""
        if how not in self.paces:
            if len(self.paces) >= PACES:
                self.paces.clear()
            self.paces[how] = Pace(self, how)
        return self.paces[how]


class Pace:
    """How far a font's codes go; strings as bytes and as written in hexadecimal: UTF-16, text and how far they go."""

    def __init__(self, font: Font, how: tuple):
        self._font, self._how = font, how
        self._steps, self.gaps = Kept(font.fonts, self._step), Kept(font.fonts, lambda written: self.gap(float(written)))
        self.strings, self.digits = Kept(font.fonts, self._string), Kept(font.fonts, lambda digits: self._string(from_hex(digits)))

    def _step(self, code: int) -> float:
        size, between, word, scale = self._how
        font = self._font
        return (font.widths.get(code, font.usual) / 1000 * size + between + (word if code == 32 and not font.wide else 0)) * scale

    def gap(self, gap: float) -> tuple[float, bool]:
        """How far a number between strings goes, and whether it stands for a space."""
        size, _, _, scale = self._how
        return gap / 1000 * size * scale, gap < -200

    def _string(self, raw: bytes) -> tuple[bytes, str, float]:
        codes = self._font.codes(raw)
        said = b"".join(map(self._font.texts.__getitem__, codes))
        return said, plain(said), sum(map(self._steps.__getitem__, codes))


def plain(said: bytes) -> str:
    """The text of UTF-16, as far as it is any."""
    return codecs.utf_16_be_decode(said, "replace", True)[0].replace("\0", "")


def times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def instructions(data: bytes, as_written: bool = False) -> Iterator[tuple[bytes, list]]:
    """Operators with what stands before them; pictures in line are passed over. If asked for, strings in hexadecimal that are drawn
    come as they are written: ``STEPS`` with (digits, x, y), ``DIGITS`` and ``ARRAY``."""
    held: list = []
    at, match = 0, INSTRUCTION.match
    while True:
        if m := match(data, at):
            at, kind = m.end(), m.lastindex
            if as_written and kind != 2 and kind != 4:
                if kind == 5:
                    yield ARRAY, PARTS.findall(m[5])
                elif stretch := STRETCH.match(data, m.start()):
                    at = stretch.end()
                    yield STEPS, STEPPED.findall(data, stretch.start(), at)
                else:
                    yield DIGITS, m[3]
            elif kind == 2:
                numbers = [float(x) if b"." in x else int(x) for x in m[1].replace(b"\0", b" ").split()]
                yield m[2], held + numbers if held else numbers
            elif kind == 5:
                yield b"TJ", [*held, [(float(n) if b"." in n else int(n)) if n else from_hex(h) for h, n in PARTS.findall(m[5])]]
            else:
                yield b"Tj", [*held, from_hex(m[3]) if kind == 3 else m[4]]
        elif (got := next(tokens(data, at), None)) is None:
            return
        else:
            value, at = got
            if not isinstance(value, Op):
                held.append(value)
                continue
            if value == b"ID":
                end = IN_LINE_END.search(data, at)
                at = end.end() if end else len(data)
            else:
                yield value, held
        held = []


#: What an instruction or a page that can't be followed raises.
FAULTS = (ArithmeticError, AttributeError, IndexError, TypeError, ValueError, zlib.error)


class Drawing:
    """The text that content streams draw, as lists of (x, y, size, width, text)."""

    def __init__(self, pdf: Pdf, shared: Fonts):
        self.pdf, self.shared, self.fonts = pdf, shared, {}

    def font(self, ref: object) -> Font | None:
        key = ref.number if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            about = self.pdf.get(ref)
            self.fonts[key] = (self.shared.font(self.pdf, about) if isinstance(about, dict) else None), ref  # the object is held, so its id stays its own
        return self.fonts[key][0]

    def runs(self, data: bytes, resources: dict, ctm: tuple = IDENTITY, depth: int = 0) -> Iterator[list[tuple]]:
        get = self.pdf.get
        fonts, forms = get(resources.get("Font"), {}), get(resources.get("XObject"), {})
        font, size, between, word, scale, leading, rise = None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0  # what q keeps, with ctm
        saved: list[tuple] = []
        line = matrix = IDENTITY
        pace: Pace | None = None  # of the font and its spacing, until one of them changes
        sides: tuple = ()  # the matrix without its place and ctm, for which the height and width of letters are known
        tall = across = 0.0
        out: list[tuple] = []

        def ready() -> Pace:
            """What is known of the font, its spacing and the size of letters here."""
            nonlocal pace, sides, tall, across
            if sides != (*matrix[:4], ctm):
                start = times(matrix, ctm)
                sides, tall, across = (*matrix[:4], ctm), (start[2] ** 2 + start[3] ** 2) ** 0.5, (start[0] ** 2 + start[1] ** 2) ** 0.5
            pace = pace or font.pace(size, between, word, scale)
            return pace

        def place(text: str, moved: float) -> None:
            nonlocal matrix
            a, b, c, d, e, f = matrix
            x, y = e * ctm[0] + f * ctm[2] + ctm[4], e * ctm[1] + f * ctm[3] + ctm[5]
            if rise:
                x, y = times((1, 0, 0, 1, 0, rise), times(matrix, ctm))[4:]
            matrix = (a, b, c, d, moved * a + e, moved * b + f)
            if text:
                out.append((x, y, abs(size) * tall, moved * across, text))

        def show(parts: list) -> None:
            if font is None:
                return
            said, moved, strings = bytearray(), 0.0, ready().strings
            for part in parts:
                if isinstance(part, bytes):
                    text, _, far = strings[part]
                    said += text
                    moved += far
                elif isinstance(part, (int, float)):
                    far, is_space = pace.gap(part)
                    moved -= far
                    if is_space and said and not said.endswith(b"\0 "):
                        said += b"\0 "
            place(plain(bytes(said)), moved)

        def show_written(parts: list[tuple]) -> None:
            """The same for pairs of which one is there as it is written."""
            if font is None:
                return
            said, moved, strings, gaps = [], 0.0, ready().digits, pace.gaps
            for digits, gap in parts:
                if gap:
                    far, is_space = gaps[gap]
                    moved -= far
                    if is_space and said and not said[-1].endswith(b"\0 "):
                        said.append(b"\0 ")
                else:
                    text, _, far = strings[digits]
                    if text:
                        said.append(text)
                    moved += far
            place(plain(b"".join(said)), moved)

        def shift(x: float, y: float) -> None:
            nonlocal line, matrix
            a, b, c, d, e, f = line
            line = matrix = (a, b, c, d, x * a + y * c + e, x * b + y * d + f)

        def stepped(pairs: list[tuple]) -> None:
            """Strings with a step after each, in one go where none is at fault."""
            nonlocal line, matrix
            try:
                known = ready().digits
                made = [known[digits] for digits, _, _ in pairs] if font is not None and not rise else None
            except FAULTS:
                made = None
            if made is None:
                for digits, x, y in pairs:
                    try:
                        show_written([(digits, b"")])
                    except FAULTS:
                        pass
                    shift(float(x), float(y))
                return
            (a, b, c, d, e, f), (p, q, r, s, t, u), (at_x, at_y), high = matrix, ctm, line[4:], abs(size) * tall
            for (_, text, moved), (_, x, y) in zip(made, pairs, strict=True):
                if text:
                    out.append((e * p + f * r + t, e * q + f * s + u, high, moved * across, text))
                x, y = float(x), float(y)
                e = at_x = x * a + y * c + at_x
                f = at_y = x * b + y * d + at_y
            line = matrix = (a, b, c, d, e, f)

        try:
            for op, args in instructions(data, True):
                try:
                    if op == STEPS:
                        stepped(args)
                    elif op == ARRAY:
                        show_written(args)
                    elif op == DIGITS:
                        if font is not None:
                            place(*ready().digits[args][1:])
                    elif op == b"Tj":
                        show(args[-1:])
                    elif op in (b"Td", b"TD"):
                        leading = -float(args[-1]) if op == b"TD" else leading
                        shift(float(args[-2]), float(args[-1]))
                    elif op == b"TJ":
                        show(args[-1])
                    elif op == b"T*":
                        shift(0, -leading)
                    elif op == b"q":
                        saved.append((ctm, font, size, between, word, scale, leading, rise))
                    elif op == b"Q":
                        if saved:
                            ctm, font, size, between, word, scale, leading, rise = saved.pop()
                            pace = None
                    elif op == b"cm":
                        ctm = times(tuple(map(float, args[-6:])), ctm)
                    elif op == b"BT":
                        line = matrix = IDENTITY
                    elif op == b"Tf":
                        font, size = self.font(fonts.get(args[-2])), float(args[-1])
                        pace = None
                    elif op in (b"Tc", b"Tw", b"Tz"):
                        between = float(args[-1]) if op == b"Tc" else between
                        word = float(args[-1]) if op == b"Tw" else word
                        scale = args[-1] / 100 if op == b"Tz" else scale
                        pace = None
                    elif op == b"TL":
                        leading = float(args[-1])
                    elif op == b"Ts":
                        rise = float(args[-1])
                    elif op == b"Tm":
                        line = matrix = tuple(map(float, args[-6:]))
                    elif op in (b"'", b'"'):
                        if op == b'"':
                            word, between = float(args[-3]), float(args[-2])
                            pace = None
                        shift(0, -leading)
                        show(args[-1:])
                    elif op == b"Do" and depth < FORMS:
                        form = get(forms.get(args[-1]))
                        if isinstance(form, Stream) and get(form.about.get("Subtype")) == "Form":
                            own = [float(get(x)) for x in get(form.about.get("Matrix"), IDENTITY)]
                            drawn = self.runs(self.pdf.content(form), get(form.about.get("Resources"), resources), times(tuple(own), ctm), depth + 1)
                            yield out
                            out = []
                            yield from drawn
                except TooLarge:
                    raise
                except FAULTS:
                    continue  # an instruction that can't be followed
                if len(out) >= RUNS:
                    yield out
                    out = []
        except FAULTS:
            yield out
            raise
        yield out


def page_rows(pdf: Pdf, drawing: Drawing, path: str, n: int, page: dict, at_once: int = RUNS) -> Iterator[tuple]:
    """The rows of a page (``PAGES``)."""
    get = pdf.get
    start, facts, notes, held, last = 0, NOTHING, [], [], NOTHING

    def row(runs: list[tuple], fault: str | None = None) -> tuple:
        nonlocal start, facts, notes, last
        made = path, "page", n, start, *facts, fault, *(zip(*notes, strict=True) if notes else NO_LINKS), *(zip(*runs, strict=True) if runs else NO_RUNS), *last
        start += (facts is not NOTHING) + len(notes) + len(runs)
        facts, notes = NOTHING, []
        if runs:
            x, y, _, width, text = runs[-1]
            last = x + width, y, text.endswith(" ")
        return made

    try:
        box = [float(x) if isinstance(x := get(v), (int, float)) else 0.0 for v in get(page.get("CropBox"), get(page.get("MediaBox"), []))]
        box = box if len(box) == 4 else [0.0, 0.0, 612.0, 792.0]
        facts = abs(box[2] - box[0]), abs(box[3] - box[1]), float(get(page.get("Rotate"), 0) % 360)
        for note in get(page.get("Annots"), []):
            note = get(note, {})
            target = get(get(note.get("A"), {}).get("URI")) if isinstance(note, dict) and get(note.get("Subtype")) == "Link" else None
            if isinstance(target, bytes):
                at = [float(get(x)) for x in get(note.get("Rect"), [0, 0])]
                notes.append((at[0], at[1], target.decode("utf-8", "replace")))
        parts = get(page.get("Contents"))
        streams = [s for s in map(get, parts if isinstance(parts, list) else [parts]) if isinstance(s, Stream)]
        for runs in drawing.runs(b"\n".join(map(pdf.content, streams)), get(page.get("Resources"), {})):
            held += runs
            while len(held) > at_once:
                yield row(held[:at_once])
                del held[:at_once]
    except TooLarge:
        yield row(held)
        raise
    except FAULTS as e:
        yield row(held, str(e))
        return
    yield row(held)


def read_pages(files: DataFrame, max_pages: int | None = None, budget: int = BUDGET, at_once: int = RUNS) -> DataFrame:
    """A row (``PAGES``) for each page of ``path, content``, more for one with more runs than are held ``at_once``, then one for the file."""
    fonts = Fonts()

    def read(row: dict) -> Iterator[tuple]:
        path, n, wrong = row["path"], 0, None
        try:
            pdf = Pdf(row["content"] or b"", budget)
            if "Encrypt" in pdf.trailer:
                raise Damaged("the document is encrypted")
            drawing = Drawing(pdf, fonts)
            for n, page in enumerate(pdf.pages(), 1):
                if max_pages is None or n <= max_pages:
                    yield from page_rows(pdf, drawing, path, n, page, at_once)
            wrong = None if n else "no pages could be read"
        except (TooLarge, Damaged) as e:
            wrong = str(e)
        yield path, "file", n, 0, *NOTHING, wrong, *NO_LINKS, *NO_RUNS, *NOTHING

    return expand(files.select("path", "content"), read, PAGES)


def read_pdf(files: DataFrame, max_pages: int | None = None, budget: int = BUDGET) -> DataFrame:
    """Rows (``ROWS``) of ``path, content``: the file (``page`` is the number of pages, ``text`` what is wrong), then
    pages (x, y: width and height; size: rotation), links (x, y of their corner) and runs, numbered from 1."""
    names = ("kind", "x", "y", "size", "width", "text")
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    one = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))
    at = F.get
    facts = F.when(F.col("width").isNotNull(), F.array(one(F.lit("page"), F.col("width"), F.col("height"), F.col("rotation"), none, no_text)))
    notes = F.transform("targets", lambda t, i: one(F.lit("link"), at("link_x", i), at("link_y", i), none, none, t))
    runs = F.transform("text", lambda t, i: one(F.lit("run"), at("x", i), at("y", i), at("size", i), at("across", i), t))
    last = F.when((F.col("kind") == "file") | F.col("fault").isNotNull(), F.array(one(F.when(F.col("kind") == "file", "file").otherwise("fault"), none, none, none, none, F.col("fault"))))
    empty = F.filter(runs, lambda _: F.lit(False))
    pages = read_pages(files, max_pages, budget)
    found = pages.select("path", "page", "start", F.posexplode(F.concat(F.coalesce(facts, empty), notes, runs, F.coalesce(last, empty))).alias("at", "row"))
    return found.select("path", "row.kind", "page", (F.col("start") + F.col("at")).alias("seq"), *(f"row.{n}" for n in names[1:]))


def texts_of(pages: DataFrame) -> DataFrame:
    """``path, page, width, height, rotation, text, n_links, fault`` of ``read_pages``'s rows: a run on another height begins a
    line, one that stands off begins a word."""
    at = F.get

    def piece(text: Column, i: Column) -> Column:
        end, last_y = F.coalesce(at("x", i - 1) + at("across", i - 1), "last_end"), F.coalesce(at("y", i - 1), "last_y")
        spaced = F.startswith(text, F.lit(" ")) | F.coalesce(F.endswith(at("text", i - 1), F.lit(" ")), "last_space")
        apart = (at("x", i) - end > at("size", i) / 5) & ~spaced
        gap = F.when(last_y.isNull(), "").when(F.abs(at("y", i) - last_y) > at("size", i) / 2, "\n").when(apart, " ").otherwise("")
        return F.concat(gap, text)

    pieces = pages.where("kind != 'file'").withColumn("piece", F.array_join(F.transform("text", piece), ""))
    facts = [F.max("width").alias("width"), F.max("height").alias("height"), F.max("rotation").cast("int").alias("rotation"), joined("piece", "start").alias("text"), F.sum(F.size("targets")).alias("n_links"), F.max("fault").alias("fault")]
    return pieces.groupBy("path", "page").agg(*facts)


def page_texts(rows: DataFrame) -> DataFrame:
    """What ``texts_of`` tells, of ``read_pdf``'s rows."""
    about = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    every = F.array_sort(F.collect_list(F.when(F.col("kind").isin("link", "run"), F.struct("seq", "kind", "x", "y", "size", "width", "text"))))
    facts = [about("page", "x").alias("width"), about("page", "y").alias("height"), about("page", "size").alias("rotation"), about("fault", "text").alias("fault"), every.alias("every")]
    of = lambda kind, c: F.transform(F.filter("every", lambda r: r["kind"] == kind), lambda r: r[c])
    runs = {"targets": of("link", "text"), "x": of("run", "x"), "y": of("run", "y"), "size": of("run", "size"), "across": of("run", "width"), "text": of("run", "text")}
    last = {"kind": F.lit("page"), "start": F.lit(0), "last_end": F.lit(None).cast("double"), "last_y": F.lit(None).cast("double"), "last_space": F.lit(None).cast("boolean")}
    return texts_of(rows.where("kind != 'file'").groupBy("path", "page").agg(*facts).withColumns(runs | last))


def links(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'link'").select("path", "page", "seq", "x", "y", F.col("text").alias("target"))


def packed_pages(data: bytes, limit: int) -> tuple[int, bool]:
    """Page objects in object streams, and whether the limit on inflated bytes left some uncounted. A stream is gone over piece by piece."""
    n = 0
    for m in OBJECTS.finditer(data):
        end = data.find(b"endstream", m.end())
        raw, tool, tail = memoryview(data)[m.end() : end if end >= 0 else len(data)], zlib.decompressobj(), b""
        try:
            while piece := tool.decompress(raw, 1 << 20):
                raw, text = tool.unconsumed_tail, tail + piece
                stop, last = max(0, len(text) - 64), 0  # what begins near the end is looked at with the next piece
                for page in PAGE.finditer(text):
                    if page.start() < stop:
                        n, last = n + 1, page.end()
                tail, limit = text[max(last, stop) :], limit - len(piece)
                if limit <= 0:
                    return n, True
        except zlib.error:  # another filter, or damaged
            pass
        n += len(PAGE.findall(tail))
    return n, False


def counted_pages(data: bytes, budget: int = BUDGET) -> tuple[int, bool]:
    """Pages by the page tree; in a file without one, page objects in the open and in object streams."""
    try:
        if n := sum(1 for _ in Pdf(data, budget).pages()):
            return n, False
    except (ArithmeticError, AttributeError, IndexError, KeyError, TypeError, ValueError, zlib.error):
        pass
    n, partial = packed_pages(data, budget) if b"/ObjStm" in data else (0, False)
    return len(PAGE.findall(data)) + n, partial


@F.pandas_udf(TELL)
def told_pages(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counted_pages(c or b"") for c in content], columns=["n", "partial"])


def with_pdf_info(files: DataFrame) -> DataFrame:
    """Add ``version, n_pages, encrypted, note`` to rows with ``content``; ``n_pages`` of a file that inflates beyond the budget is a lower bound, as its note says."""
    raw = F.decode("content", "ISO-8859-1")
    n, partial = F.col("__told.n"), F.col("__told.partial")
    text = F.concat(F.when(partial, "at least ").otherwise(""), n.cast("string"))
    note = F.when(n > MAX_PAGES, F.concat(text, F.lit(f" pages, the first {MAX_PAGES} of them shown"))).when(partial, F.concat(text, F.lit(" pages"))).when(n == 1, "1 page").when(n > 0, F.concat(text, F.lit(" pages")))
    added = {"version": F.regexp_extract(raw, r"^%PDF-([0-9]+\.[0-9]+)", 1), "n_pages": F.when(F.col("content").isNotNull(), n), "encrypted": raw.contains("/Encrypt"), "note": note}
    return files.withColumn("__told", told_pages("content")).withColumns(added).drop("__told")


def pdf_info(files: DataFrame) -> DataFrame:
    return with_pdf_info(files.select("path", "content")).drop("content")
