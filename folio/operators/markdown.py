"""Markdown as blocks of HTML: the common part of GitHub's dialect, raw HTML off.

Headings (ATX and setext), paragraphs, fenced and indented code, quotes, bullet, numbered
and task lists, tables and rules; emphasis, strong, strikethrough, code, links, images and
autolinks. Links with a scheme that is not allowed lead to ``#blocked``.

Definitions of link targets and footnotes are gathered from the whole text before any span is read, so
they may come after their use. Of equal labels the first counts. Footnotes follow the text as a
list, in the order of their first use, each with the way back to all of its uses.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import decode_entities
from folio.operators.rows import expand

_FENCE = re.compile(r" {0,3}(`{3,}+|~{3,}+)\s*+([^\s`]*+)[^`]*+$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)$")
_ITEM = re.compile(r"( {0,3})([-*+]|[0-9]{1,9}[.)])(?:[ \t]++(.*)|)$")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_DIVIDER = re.compile(r" {0,3}\|?+[ \t]*+:?+-++:?+[ \t]*+(?:\|[ \t]*+:?+-++:?+[ \t]*+)*+\|?+[ \t]*+$")
#: What means something inside of a line; text between two such things is plain.
_TOKEN = re.compile(
    r"\\(?P<escape>[!-/:-@\[-`{-~])|(?P<ticks>`++)|(?P<open>!?\[)|(?P<close>\])|<(?P<auto>(?:https?|mailto|ftp):[^\s<>]*+)>|(?P<run>\*++|_++|~++)"
    r"|(?<![\w/])(?P<bare>(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)'])|(?P<break>(?:(?<! )  ++|\\)\n)|(?P<entity>&(?:[A-Za-z][A-Za-z0-9]{0,31}|\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6});)"
)
_TARGET = re.compile(r"\(\s*+<?+((?:[^\s()<>]|\([^\s()]*+\))*+)>?+(?:\s++(?:\"([^\"]*+)\"|'([^']*+)'))?+\s*+\)")
_DEFINITION = re.compile(r" {0,3}\[(?!\^)((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*+(?:<([^<>]*+)>|(\S++))(?:[ \t]++(?:\"([^\"]*+)\"|'([^']*+)'|\(([^()]*+)\)))?+[ \t]*+$")
_NOTE = re.compile(r" {0,3}\[\^([^\]\s]{1,99})\]:[ \t]*(.*)$")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999}+)\]")
#: How deep quotes and lists may lie in each other; what is deeper is a paragraph.
MAX_NESTING = 32


def escaped(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


def allowed(url: str) -> bool:
    bare = re.sub(r"[\x00-\x20\x7f]", "", decode_entities(url)).lower()
    scheme = re.match(r"[^/?#:]{0,30}:", bare)
    return scheme is None or scheme[0] in ("http:", "https:", "mailto:")


def link(url: str, inner: str, title: str | None = None) -> str:
    target = escaped(decode_entities(url)) if allowed(url) else "#blocked"
    return f'<a href="{target}"' + (f' title="{escaped(title)}"' if title else "") + f">{inner}</a>"


class Run:
    """A run of ``*``, ``_`` or ``~`` that may open or close emphasis; what is not used up stays as it is."""

    def __init__(self, chars: str, before: str, after: str):
        self.char, self.left, self.length = chars[0], len(chars), len(chars)
        space = lambda c: not c or c.isspace()
        mark = lambda c: bool(c) and not c.isalnum() and not c.isspace()
        opening = not space(after) and (not mark(after) or space(before) or mark(before))
        closing = not space(before) and (not mark(before) or space(after) or mark(after))
        self.opens = opening and (self.char != "_" or not closing or mark(before))
        self.closes = closing and (self.char != "_" or not opening or mark(after))
        self.opened: list[str] = []
        self.closed: list[str] = []

    def fits(self, closer: Run) -> bool:
        if self.char != closer.char or (self.char == "~" and not self.left == closer.left <= 2):
            return False
        either = self.closes or closer.opens
        return self.char == "~" or not either or (self.length + closer.length) % 3 > 0 or self.length % 3 == closer.length % 3 == 0

    def __str__(self) -> str:
        return "".join(self.closed) + self.char * self.left + "".join(reversed(self.opened))


def emphasize(runs: list[Run]) -> None:
    """Pair runs off, each closer with the nearest opener that fits. What a search has passed over in vain is not searched again."""
    openers: list[Run] = []
    searched: dict[tuple, int] = {}
    for run in runs:
        kind = (run.char, run.opens, run.length % 3, run.left if run.char == "~" else 0)
        while run.closes and run.left:
            at = len(openers) - 1
            while at >= searched.get(kind, 0) and not openers[at].fits(run):
                at -= 1
            if at < searched.get(kind, 0):
                searched[kind] = len(openers)
                break
            opener = openers[at]
            used = run.left if run.char == "~" else 2 if min(opener.left, run.left) > 1 else 1
            tag = "del" if run.char == "~" else "strong" if used == 2 else "em"
            opener.opened.append(f"<{tag}>")
            run.closed.append(f"</{tag}>")
            opener.left, run.left = opener.left - used, run.left - used
            del openers[at + (opener.left > 0) :]
            searched = {k: min(v, len(openers)) for k, v in searched.items()}
        if run.opens and run.left:
            openers.append(run)


def label(text: str) -> str:
    """A label as it is compared: without case, white space as one space."""
    return " ".join(text.split()).casefold()


class Definitions:
    """What a text defines: targets and titles by label, and lines of footnotes; and which footnotes its spans used, in order."""

    def __init__(self) -> None:
        self.links: dict[str, tuple[str, str | None]] = {}
        self.notes: dict[str, list[str]] = {}
        self.used: dict[str, int] = {}
        self.numbers: dict[str, int] = {}

    def take(self, lines: list[str]) -> list[str]:
        """The lines without definitions. Those within code, and targets that would go on a paragraph, are none."""
        rest: list[str] = []
        fence = None
        at, in_paragraph = 0, False
        while at < len(lines):
            line = lines[at]
            at += 1
            if fence:
                rest.append(line)
                fence = None if fence.match(line) else fence
                continue
            if m := _FENCE.match(line):
                fence = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ ]*$")
            elif m := _NOTE.match(line):
                body = [m[2]]
                while at < len(lines) and (lines[at].startswith("    ") or not lines[at].strip() and at + 1 < len(lines) and lines[at + 1].startswith("    ")):
                    body.append(lines[at][4:])
                    at += 1
                self.notes.setdefault(label(m[1]), body)
                in_paragraph = False
                continue
            elif not in_paragraph and (m := _DEFINITION.match(line)) and m[1].strip():
                self.links.setdefault(label(m[1]), (m[3] if m[2] is None else m[2], next((t for t in m.groups()[3:] if t is not None), None)))
                continue
            in_paragraph = bool(line.strip()) and not line.startswith("    ") and not _HEADING.match(line) and not _RULE.match(line)
            rest.append(line)
        return rest

    def note(self, name: str) -> str:
        """A footnote's reference."""
        nth = self.numbers.setdefault(name, len(self.numbers) + 1)
        uses = self.used[name] = self.used.get(name, 0) + 1
        return f'<sup class="footnote-ref"><a href="#fn-{nth}" id="fnref-{nth}{f"-{uses}" if uses > 1 else ""}">{nth}</a></sup>'


NOTHING = Definitions()


def inline(text: str, defined: Definitions = NOTHING) -> str:
    """The spans of a paragraph, in one pass: code, links and pictures by a stack of brackets, then emphasis."""
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    out: list[str | Run] = []
    runs: list[Run] = []
    brackets: list[tuple[int, int, bool, int]] = []  # places in ``out``, ``runs`` and the text, and whether it is a picture
    at = linked = 0  # brackets up to ``linked`` hold a link, so those for links among them are plain text
    while m := _TOKEN.search(text, at):
        out.append(escaped(text[at : m.start()]))
        at = m.end()
        if m["escape"]:
            out.append(escaped(m["escape"]))
        elif m["ticks"]:
            ends = ticks.get(len(m[0]), [])
            k = bisect_left(ends, at)
            if k == len(ends):
                out.append(m[0])
            else:
                code = text[at : ends[k]].replace("\n", " ")
                out.append(f"<code>{escaped(code[1:-1] if len(code) > 2 and code[0] == code[-1] == ' ' and code.strip() else code)}</code>")
                at = ends[k] + len(m[0])
        elif m["open"]:
            if defined.notes and m[0] == "[" and (n := _LABEL.match(text, m.start())) and n[1].startswith("^") and label(n[1][1:]) in defined.notes:
                out.append(defined.note(label(n[1][1:])))
                at = n.end()
                continue
            brackets.append((len(out), len(runs), m[0] == "![", at))
            out.append(m[0])
        elif m["close"]:
            target = _TARGET.match(text, at) if brackets else None
            opened, first, is_picture, begun = brackets.pop() if brackets else (0, 0, False, 0)
            plain = not is_picture and len(brackets) < linked
            linked = min(linked, len(brackets))
            url, title = (target[1], target[2] if target[2] is not None else target[3]) if target else (None, None)
            if target is None and begun and defined.links:
                named = _LABEL.match(text, at)
                said = named[1] if named and named[1].strip() else text[begun : m.start()] if m.start() - begun <= 999 else ""
                if label(said) in defined.links:
                    (url, title), target = defined.links[label(said)], named if named and (named[1].strip() or not named[1]) else m
            if target is None or plain:
                out.append("]")
                continue
            at = target.end()
            emphasize(runs[first:])
            inner = "".join(map(str, out[opened + 1 :]))
            del out[opened:], runs[first:]
            if is_picture:
                out.append(f'<img src="{escaped(decode_entities(url))}" alt="{re.sub("<[^>]*>", "", inner)}"' + (f' title="{escaped(title)}"' if title else "") + ">")
            else:
                out.append(link(url, inner, title))
                linked = len(brackets)  # links do not hold links
        elif m["auto"]:
            out.append(link(m["auto"], escaped(m["auto"])))
        elif m["run"]:
            runs.append(Run(m[0], text[m.start() - 1] if m.start() else "", text[at : at + 1]))
            out.append(runs[-1])
        elif m["bare"]:
            out.append(link(m["bare"] if "://" in m["bare"] else f"http://{m['bare']}", escaped(m["bare"])))
        elif m["break"]:
            out.append("<br>\n")
        else:
            name = m["entity"]
            out.append(escaped(html.unescape(name) if name[1] == "#" else html5.get(name[1:], name)))
    out.append(escaped(text[at:]))
    emphasize(runs)
    return "".join(map(str, out))


def cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip().removeprefix("|"))
    return [p.strip().replace("\\|", "|") for p in (parts[:-1] if parts[-1].strip() == "" and len(parts) > 1 else parts)]


def table(head: str, divider: str, rows: list[str], defined: Definitions = NOTHING) -> str:
    sides = [{(True, True): "center", (False, True): "right", (True, False): "left"}.get((d.startswith(":"), d.endswith(":"))) for d in cells(divider)]
    row = lambda line, tag: "<tr>" + "".join(f"<{tag}" + (f' align="{s}"' if s else "") + f">{inline(c, defined)}</{tag}>" for c, s in zip((*cells(line), *[""] * len(sides)), sides, strict=False)) + "</tr>\n"
    return "<table>\n<thead>\n" + row(head, "th") + "</thead>\n" + ("<tbody>\n" + "".join(row(r, "td") for r in rows) + "</tbody>\n" if rows else "") + "</table>\n"


def lines_of(text: str) -> list[str]:
    """Lines with tabs at the start as spaces up to the next stop of four; later ones stay."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return [(x[: len(x) - len(x.lstrip(" \t"))].expandtabs(4) + x.lstrip(" \t") if x[:1] in " \t" else x) if "\t" in x else x for x in lines]


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """Kind and HTML of each block, in order, and at last the footnotes."""
    defined = Definitions()
    lines = defined.take(lines_of(text))
    yield from _blocks(lines, defined)
    names, items = [], []
    while len(items) < len(defined.used):  # a footnote may use others
        names = names if len(names) > len(items) else list(defined.used)
        name = names[len(items)]
        items.append((name, "".join(h for _, h in _blocks(defined.notes[name], defined, tight=True))))
    if items:
        back = lambda n, uses: " ".join(f'<a href="#fnref-{n}{f"-{k}" if k > 1 else ""}" class="footnote-backref">\u21a9</a>' for k in range(1, uses + 1))
        rows = "".join(f'<li id="fn-{n}">{body} {back(n, defined.used[name])}</li>\n' for n, (name, body) in enumerate(items, 1))
        yield "footnotes", f'<section class="footnotes">\n<ol>\n{rows}</ol>\n</section>\n'


def _blocks(lines: list[str], defined: Definitions, tight: bool = False, depth: int = 0) -> Iterator[tuple[str, str]]:
    """Below ``MAX_NESTING`` there are no more quotes and lists."""
    nests = depth < MAX_NESTING
    at = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := _FENCE.match(line):
            close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ ]*$")
            end = next((k for k in range(at + 1, len(lines)) if close.match(lines[k])), len(lines))
            css = f' class="language-{escaped(m[2])}"' if m[2] else ""
            body = "".join(escaped(x) + "\n" for x in lines[at + 1 : end])
            yield "code", f"<pre><code{css}>{body}</code></pre>\n"
            at = end + 1
        elif m := _HEADING.match(line):
            title = line[m.end() :].strip()
            bare = title.rstrip("#")
            title = bare.rstrip() if not bare or bare[-1].isspace() else title
            yield f"h{len(m[1])}", f"<h{len(m[1])}>{inline(title, defined)}</h{len(m[1])}>\n"
            at += 1
        elif _RULE.match(line):
            yield "hr", "<hr>\n"
            at += 1
        elif line.startswith("    "):
            end = next((k for k in range(at, len(lines)) if lines[k].strip() and not lines[k].startswith("    ")), len(lines))
            body = "\n".join(x[4:] for x in lines[at:end]).rstrip("\n ")
            yield "code", f"<pre><code>{escaped(body)}\n</code></pre>\n"
            at = end
        elif nests and re.match(" {0,3}>", line):
            end = next((k for k in range(at, len(lines)) if not lines[k].strip()), len(lines))
            inner = [re.sub("^ {0,3}> ?", "", x) for x in lines[at:end]]
            yield "quote", "<blockquote>\n" + "".join(h for _, h in _blocks(inner, defined, depth=depth + 1)) + "</blockquote>\n"
            at = end
        elif nests and (m := _ITEM.match(line)):
            at = yield from _list(lines, at, m, defined, depth)
        elif at + 1 < len(lines) and "|" in line and _DIVIDER.match(lines[at + 1]) and len(cells(line)) == len(cells(lines[at + 1])):
            end = next((k for k in range(at + 2, len(lines)) if not lines[k].strip()), len(lines))
            yield "table", table(line, lines[at + 1], lines[at + 2 : end], defined)
            at = end
        else:
            end = at + 1
            while end < len(lines) and lines[end].strip() and not (_FENCE.match(lines[end]) or _HEADING.match(lines[end]) or _RULE.match(lines[end]) or re.match(r" {0,3}(>|[-*+][ \t]|1[.)][ \t]|=+[ \t]*$|-+[ \t]*$)", lines[end])):
                end += 1
            under = re.match(r" {0,3}(=+|-+)[ \t]*$", lines[end]) if end < len(lines) else None
            body = inline("\n".join(x.lstrip() for x in lines[at:end]).rstrip(), defined)
            tag = ("h1" if "=" in under[1] else "h2") if under else "p"
            yield tag, body if tight and tag == "p" else f"<{tag}>{body}</{tag}>\n"
            at = end + bool(under)


def _list(lines: list[str], at: int, first: re.Match, defined: Definitions, depth: int):
    """The list that begins here; its items hold blocks of their own."""
    ordered = first[2][-1] in ".)"
    same = lambda m: m and (m[2][-1] == first[2][-1] if ordered else m[2] == first[2])
    items, loose = [], False
    while at < len(lines) and same(m := _ITEM.match(lines[at])):
        width = len(m[1]) + len(m[2]) + 1
        body, at = [m[3] or ""], at + 1
        while at < len(lines):
            blank = not lines[at].strip()
            if blank and not (at + 1 < len(lines) and (lines[at + 1].startswith(" " * width) or same(_ITEM.match(lines[at + 1])))):
                break
            if not blank and not lines[at].startswith(" " * width) and (_ITEM.match(lines[at]) or not body[-1].strip() or _HEADING.match(lines[at]) or _FENCE.match(lines[at])):
                break
            loose |= blank
            body.append(lines[at][width:] if lines[at].startswith(" " * width) else lines[at].lstrip())
            at += 1
        items.append("\n".join(body))
    start = int(first[2][:-1]) if ordered else 1
    tag = "ol" if ordered else "ul"
    out = f'<{tag} start="{start}">\n' if ordered and start != 1 else f"<{tag}>\n"
    for body in items:
        task = _TASK.match(body)
        box = f'<input type="checkbox" class="task-list-item-checkbox" disabled{" checked" if task[1] != " " else ""}>' if task else ""
        inner = "".join(h for _, h in _blocks((body[task.end() :] if task else body).split("\n"), defined, tight=not loose, depth=depth + 1))
        out += f"<li{' class=\"task-list-item\"' if task else ''}>{box}{inner}</li>\n"
    yield tag, out + f"</{tag}>\n"
    return at


def to_html(text: str) -> str:
    return "".join(h for _, h in blocks(text))


@F.pandas_udf(T.StringType())
def markdown_html(text: pd.Series) -> pd.Series:
    return text.map(to_html, na_action="ignore")


def md_blocks(texts: DataFrame) -> DataFrame:
    """``path, seq, kind, html`` of ``path, text`` rows."""

    def read(row: dict) -> Iterator[tuple]:
        for seq, (kind, body) in enumerate(blocks(row["text"] or "")):
            yield row["path"], seq, kind, body

    return expand(texts.select("path", "text"), read, "path string, seq int, kind string, html string")
