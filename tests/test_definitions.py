"""Reference links, footnotes and tabs of Markdown, and the time of odd brackets."""

import random
import time

import pytest

from folio.operators.markdown import blocks, to_html

A = '<a href="/u" title="t">{}</a>'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[a][l] [L][] [l]\n\n[l]: /u 't'", f"<p>{A.format('a')} {A.format('L')} {A.format('l')}</p>\n"),
        ("[l]: </u> (t)\n[*b*][ L ] ![p][l]", f"<p>{A.format('<em>b</em>')} <img src=\"/u\" alt=\"p\" title=\"t\"></p>\n"),
        ("[x][none] [none] [l][none]\n\n[l]: /u", "<p>[x][none] [none] [l][none]</p>\n"),
        ("[l]\n\n[l]: /first\n[L]: /second", '<p><a href="/first">l</a></p>\n'),
        ("text\n[l]: /u", "<p>text\n[l]: /u</p>\n"),  # no definition within a paragraph
        ("```\n[l]: /u\n```\n[l]", "<pre><code>[l]: /u\n</code></pre>\n<p>[l]</p>\n"),
        ("> [l]\n\n- [l]\n\na | b\n--|--\n[l] | c\n\n# [l]\n\n[l]: /u", '<blockquote>\n<p><a href="/u">l</a></p>\n</blockquote>\n<ul>\n<li><a href="/u">l</a></li>\n</ul>\n<table>\n<thead>\n<tr><th>a</th><th>b</th></tr>\n</thead>\n<tbody>\n<tr><td><a href="/u">l</a></td><td>c</td></tr>\n</tbody>\n</table>\n<h1><a href="/u">l</a></h1>\n'),
        ("[l]\n\n[l]: javascript:x", '<p><a href="#blocked">l</a></p>\n'),
        ("[a [b](/x) c](/y) [[l]](/z)\n\n[l]: /u", '<p>[a <a href="/x">b</a> c](/y) [<a href="/u">l</a>](/z)</p>\n'),
        ("![a [b](/x)](/y)", '<p><img src="/y" alt="a b"></p>\n'),
        ("[ß \n é]\n\n[SS É]: /u", '<p><a href="/u">ß \né</a></p>\n'),
        ("\tcode\twith\n\n-\titem\tx", "<pre><code>code\twith\n</code></pre>\n<ul>\n<li>item\tx</li>\n</ul>\n"),
    ],
)
def test_definitions(text, want):
    assert to_html(text) == want


def test_footnotes():
    text = "one[^b] two[^a] again[^b] none[^c]\n\n[^a]: see [^d]\n    more\n\n[^b]: *said*\n[^d]: deep\n[^e]: unused"
    ref = lambda n, k="": f'<sup class="footnote-ref"><a href="#fn-{n}" id="fnref-{n}{k}">{n}</a></sup>'
    back = lambda n, k="": f'<a href="#fnref-{n}{k}" class="footnote-backref">↩</a>'
    kinds = list(blocks(text))
    assert kinds[0] == ("p", f"<p>one{ref(1)} two{ref(2)} again{ref(1, '-2')} none[^c]</p>\n")
    assert kinds[1] == ("footnotes", '<section class="footnotes">\n<ol>\n' + f'<li id="fn-1"><em>said</em> {back(1)} {back(1, "-2")}</li>\n<li id="fn-2">see {ref(3)}\nmore {back(2)}</li>\n<li id="fn-3">deep {back(3)}</li>\n' + "</ol>\n</section>\n")
    assert len(kinds) == 2


def test_odd_brackets_take_linear_time():
    n = 20_000
    for text in ("![" * n + "[a](b) " * n, "[" * n + "[a](b)" * n + "]" * n, "[l]" * n + "\n\n[l]: /u", "[" * n + "][l]" * n + "\n\n[l]: /u", "[^x]" * n + "\n\n[^x]: y", "".join(f"[^{k}]" for k in range(n // 4)) + "\n\n" + "\n".join(f"[^{k}]: n" for k in range(n // 4))):
        began = time.perf_counter()
        assert to_html(text)
        assert time.perf_counter() - began < 5


def test_any_text_ends():
    rnd = random.Random(6)
    parts = ["[", "]", "(", ")", ":", "^", "a", "l", "!", "\n", "\n\n", "    ", "\t", "[l]: /u\n", "[^a]: n\n", "*", "`", "> ", "- ", "|", "\\"]
    for _ in range(3000):
        assert isinstance(to_html("".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))), str)
