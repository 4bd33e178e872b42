"""ZIP members and XML events.

``Container`` reads the wanted members only, within a budget on their declared sizes. Large members
are inflated piece by piece, and the XML reader goes on where a piece ended it, so memory
is that of a piece and of the longest text or tag. The XML reader tolerates malformed
text: it never fails, and keeps names as written, prefix included.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Callable, Generator, Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame

from folio.functions.text import decode_entities
from folio.operators.rows import expand

#: Bytes that may be inflated per container.
BUDGET = 512 * 1024 * 1024
NAME_CHARS = 79
#: Members of more bytes are read in pieces of so many.
WHOLE, PIECE = 4 << 20, 1 << 18

PARTS = "path string, part string, declared long, content binary, refused boolean"
NODES = "path string, part string, ev_id int, ev string, name string, attrs map<string,string>, text string"

_MARKUP = re.compile(r"<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<!--.*?(?:-->|$)|<\?.*?(?:\?>|$)|<![^>]*(?:>|$)|<(?P<end>/?)(?P<name>[^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
NO_ATTRS: dict[str, str] = {}
Event = tuple[str, str, dict[str, str], str]


class Container:
    """A ZIP archive opened once; every read draws on one budget. ``ok`` tells whether it opens at all."""

    def __init__(self, content: bytes | None, budget: int = BUDGET):
        self._left = budget
        #: Names of members that were asked for when the budget couldn't hold them.
        self.refused: list[str] = []
        self._infos: dict[str, zipfile.ZipInfo] = {}
        try:
            self._archive = zipfile.ZipFile(io.BytesIO(content or b""))
            for info in self._archive.infolist():
                self._infos.setdefault(info.filename, info)
            self.ok = True
        except Exception:
            self.ok = False

    def names(self, wanted: str) -> list[str]:
        return [n for n in self._infos if re.fullmatch(wanted, n)]

    def declared(self, name: str) -> int:
        return self._infos[name].file_size

    def holds(self, name: str) -> bool:
        """Whether a member is there, within what is left of the budget."""
        return name in self._infos and self._infos[name].file_size <= self._left

    def _within(self, name: str) -> zipfile.ZipInfo | None:
        """A member that is there and within the budget; one that isn't is noted."""
        if name in self._infos and not self.holds(name):
            self.refused.append(name)
        return self._infos[name] if self.holds(name) else None

    def read(self, name: str) -> bytes | None:
        """The bytes of a member; none if it is missing, damaged, encrypted or beyond the budget."""
        info = self._within(name)
        if info is None:
            return None
        try:
            with self._archive.open(info) as member:
                data = member.read(info.file_size + 1)
        except Exception:  # a damaged or encrypted member counts as missing
            return None
        if len(data) > info.file_size:
            return None
        self._left -= len(data)
        return data

    def part(self, name: str) -> Callable[[], Iterator[Event]] | None:
        """What gives the XML events of a member, each time from its start; none in the cases of ``read``. A large member isn't
        held, but inflated anew, and at once to see whether it is sound."""
        info = self._within(name)
        if info is None or info.file_size <= WHOLE:
            data = self.read(name) if info else None
            return None if data is None else lambda: events(data.decode("utf-8", "replace"))

        def pieces() -> Iterator[bytes]:
            with self._archive.open(info) as member:
                yield from iter(lambda: member.read(PIECE), b"")

        def read() -> Iterator[Event]:
            decode = codecs.getincrementaldecoder("utf-8")("replace").decode
            return streamed_events(decode(piece, not piece) for piece in chain(pieces(), [b""]))

        try:
            size = sum(map(len, pieces()))
        except Exception:  # a damaged or encrypted member counts as missing
            return None
        if size > info.file_size:
            return None
        self._left -= size
        return read

    def xml(self, name: str) -> Iterator[Event]:
        part = self.part(name)
        return part() if part else iter(())


def members(content: bytes | None, wanted: str, budget: int = BUDGET) -> Iterator[tuple[str, int, bytes | None]]:
    """Name, declared size and bytes of the members whose whole name matches; no bytes beyond the budget."""
    archive = Container(content, budget)
    for name in archive.names(wanted):
        yield name, archive.declared(name), archive.read(name)


def parts(files: DataFrame, wanted: str, budget: int = BUDGET) -> DataFrame:
    """The members of each ``path, content`` whose name matches the pattern."""

    def read(row: dict) -> Iterator[tuple]:
        for name, declared, data in members(row["content"], wanted, budget):
            yield row["path"], name, declared, data, data is None

    return expand(files.select("path", "content"), read, PARTS)


def _ended(xml: str, here: int) -> bool:
    """Whether the markup that begins there is all in the text."""
    if xml.startswith("<?", here):
        return xml.find("?>", here) >= 0
    if xml.startswith("<!", here):
        if len(xml) - here < len("<![CDATA["):
            return False
        end = "]]>" if xml.startswith("<![CDATA[", here) else "-->" if xml.startswith("<!--", here) else ">"
        return xml.find(end, here + (9 if end == "]]>" else 4 if end == "-->" else 0)) >= 0
    m = _MARKUP.match(xml, here)
    return m is not None and m[0].endswith(">")


def _events(xml: str, whole: bool) -> Generator[Event, None, int]:
    """Events of a text, or of a piece of one up to what may go on after it; returns how far they go."""
    at = 0
    while at < len(xml):
        here = xml.find("<", at)
        if not whole and (here < 0 or not _ended(xml, here)):
            return at
        here = len(xml) if here < 0 else here
        if here > at:
            yield "text", "", NO_ATTRS, decode_entities(xml[at:here])
        if here == len(xml):
            break
        m = _MARKUP.match(xml, here)
        at = m.end() if m else len(xml)
        if m and m["cdata"] is not None:
            if m["cdata"]:
                yield "text", "", NO_ATTRS, decode_entities(m["cdata"])
        elif m and m["name"]:
            name = m["name"][:NAME_CHARS]
            if m["end"]:
                yield "end", name, NO_ATTRS, ""
            else:
                attrs: dict[str, str] = {}
                for a in _ATTRIBUTE.finditer(m["rest"]):
                    attrs.setdefault(a[1].rpartition(":")[2], decode_entities(a[2] if a[2] is not None else a[3]))
                yield "empty" if m["rest"].rstrip().endswith("/") else "start", name, attrs, ""
    return len(xml)


def events(xml: str) -> Iterator[Event]:
    """Kind (start, empty, end, text), name, attributes by local name (the first counts) and text."""
    yield from _events(xml, True)


def streamed_events(pieces: Iterable[str]) -> Iterator[Event]:
    """The events of the pieces' text as a whole. What goes over the end of a piece is looked at again when twice as much is there,
    so a long text or tag takes linear time too."""
    more, held, wanted = iter(pieces), "", 0
    while True:
        parts, size, piece = [held], len(held), ""
        while piece is not None and size <= wanted:
            if (piece := next(more, None)) is not None:
                parts.append(piece)
                size += len(piece)
        held = "".join(parts)
        done = yield from _events(held, piece is None)
        if piece is None:
            return
        held = held[done:]
        wanted = 2 * len(held)


def part_nodes(files: DataFrame, wanted: str) -> DataFrame:
    """XML events of the members whose name matches the pattern."""

    def read(row: dict) -> Iterator[tuple]:
        archive = Container(row["content"])
        for name in archive.names(wanted):
            for k, (ev, tag, attrs, text) in enumerate(archive.xml(name)):
                yield row["path"], name, k, ev, tag, list(attrs.items()), text

    return expand(files.select("path", "content"), read, NODES)


def xml_nodes(texts: DataFrame) -> DataFrame:
    """XML events of ``path, text`` rows."""

    def read(row: dict) -> Iterator[tuple]:
        for k, (ev, tag, attrs, text) in enumerate(events(row["text"] or "")):
            yield row["path"], "", k, ev, tag, list(attrs.items()), text

    return expand(texts.select("path", "text"), read, NODES)


def relations(archive: Container, name: str) -> dict[str, str]:
    """Targets by id, the first of equal ids."""
    found: dict[str, str] = {}
    for ev, tag, attrs, _ in archive.xml(name):
        if ev in ("start", "empty") and "Relationship" in tag and tag != "Relationships" and "Id" in attrs and "Target" in attrs:
            found.setdefault(attrs["Id"], attrs["Target"])
    return found
