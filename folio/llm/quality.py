"""Quality rules as a short-circuit cascade.

The base figures of a text are counted once. Texts that the base rules pass then
meet further rules one after the other, and the first that rejects a text ends its
cascade; what only a later rule would read is never computed. The order comes from a sample:
each rule's cost and rejected share are measured on an executor and rules run by rejected
share per cost, highest first. The order changes only the time taken, never a verdict, as a
text is kept if no rule rejects it.

Defined results: a null text has no words and fails the base rules (under ten
words); an empty table gives an empty result; repeated rows are judged one by one;
other columns pass through, replaced by added columns of the same name.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Bytes that are neither white space nor a letter; those of other scripts count as letters.
NO_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha() and b not in SPACES)
#: Documents of the sample, at most: the first of an eighth of all texts. It only decides the order of the rules.
SAMPLE_DOCS = 256

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Sequence[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    top, key, spare = len(known), ids[:n], 2**62
    most = top
    for k in range(1, width):
        if most > spare // top:  # dense ranks keep the key exact
            key = np.unique(key, return_inverse=True)[1]
            most = len(key)
        key, most = key * top + ids[k : k + n], most * top
    in_order = np.sort(key)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, np.unique(twice))
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += hit
    edges[width : width + n] -= hit
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Text:
    """A text's bytes and the figures that rules read."""

    def __init__(self, raw: bytes, n_chars: int):
        self.raw, self.words = raw, raw.split()
        self.n_words = len(self.words)
        self.word_chars = n_chars - (len(raw) - len(raw.translate(None, SPACES)))
        self.n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        self.n_lines, self.n_dup_lines = len(lines), len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(self.words)

    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def too_many_symbols(t: Text) -> bool:
    return 10 * t.n_symbols > t.n_words


def too_many_equal_lines(t: Text) -> bool:
    return 5 * t.n_dup_lines > 2 * t.n_lines


def odd_word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 30 * t.n_words


def too_few_letters(t: Text) -> bool:
    """Under half of the words hold a letter."""
    return 2 * len(t.raw.translate(None, NO_LETTERS).split()) < t.n_words


def bullet_lines(t: Text) -> bool:
    """Over nine tenths of the lines begin as list items."""
    lines = [x.lstrip() for x in t.raw.split(b"\n")]
    return 10 * sum(x.startswith((b"- ", b"* ", b"\xe2\x80\xa2")) for x in lines) > 9 * max(1, t.n_lines)


def ellipsis_lines(t: Text) -> bool:
    """Over three tenths of the lines are broken off."""
    return 10 * sum(x.rstrip().endswith((b"...", b"\xe2\x80\xa6")) for x in t.raw.split(b"\n")) > 3 * t.n_lines


def shouting(t: Text) -> bool:
    """Over half of the words are in capitals, or there is an exclamation mark for every five words."""
    return 5 * t.raw.count(b"!") > t.n_words or 2 * sum(w.isupper() for w in t.words) > t.n_words


def many_braces(t: Text) -> bool:
    return 10 * (t.raw.count(b"{") + t.raw.count(b"}")) > t.n_words


def one_pair_again(t: Text) -> bool:
    """The most frequent pair of words makes up over a fifth of the text, and stands there three times or more."""
    most = max(Counter(zip(t.words, t.words[1:], strict=False)).values(), default=0)
    return most > 2 and 10 * most > t.n_words


def long_repeats(t: Text) -> bool:
    """Over three twentieths of the words are in windows of ten that are found twice or more."""
    return 20 * repeated_words(t.words, 10) > 3 * t.n_words


Rule = Callable[[Text], bool]
RULES: dict[str, Rule] = {f.__name__: f for f in (too_few_letters, bullet_lines, odd_word_length, too_many_equal_lines, too_many_symbols, ellipsis_lines, shouting, many_braces, one_pair_again, long_repeats)}


def cascade_order(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """The rules' names by rejected share per second on at most ``sample_docs`` texts. Only the figures come to the driver."""
    rules = RULES if rules is None else rules

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(0)[at].as_py()
                t = Text(text.encode(), len(text))
                if t.base_failed():
                    continue
                n += 1
                for name, rule in rules.items():
                    began = time.perf_counter()
                    rejected[name] += bool(rule(t))
                    seconds[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "seconds": [seconds[r] for r in rules], "rejected": [rejected[r] for r in rules], "n": [n] * len(rules)})

    drawn = df.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull() & (F.pmod(F.xxhash64("t"), F.lit(8)) == 0)).limit(sample_docs)
    told = drawn.mapInArrow(measure, "rule string, seconds double, rejected long, n long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "n"))).collect()
    worth = {r.rule: (r.rejected + 0.5) / (r.n + 1) / max(r.seconds, 1e-7) for r in told}
    return sorted(rules, key=lambda name: -worth.get(name, 0))


def with_quality(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Add the base figures, ``base_failed`` and ``kept`` to each row; no shuffle."""
    rules = RULES if rules is None else rules
    steps = [rules[n] for n in (cascade_order(df, text_col, rules) if order is None else order)]
    added = {n: T.LongType() for n in FIGURES} | {"base_failed": T.BooleanType(), "kept": T.BooleanType()}
    before = [f for f in df.schema.fields if f.name not in added]
    names = [f.name for f in before]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = pc.fill_null(batch.column("__text"), "")
                rows = []
                for raw, n in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), strict=True):
                    t = Text(raw, n)
                    failed = t.base_failed()
                    rows.append((*(getattr(t, f) for f in FIGURES), failed, not failed and not any(step(t) for step in steps)))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(x, pa.bool_() if k >= len(FIGURES) else pa.int64()) for k, x in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=[*names, *added])

    schema = T.StructType([*before, *(T.StructField(k, t) for k, t in added.items())])
    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)
