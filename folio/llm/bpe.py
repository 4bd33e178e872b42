"""Byte-level BPE by monoid tree reduction.

A text's halves are encoded recursively down to small leaves. Two neighbours are
joined by encoding a window around their border again. The window grows on either
side until it ends at a *fixed cut*: a place where the splitting pattern ends one
match and starts the next whatever else the text holds. Tokens beyond a fixed cut
depend on nothing before it, so they provably stay as they are. Encodings with
this join form a monoid (the empty text is the unit); so do decodings with
concatenation, and both are evaluated as trees.

Defined results: a null text counts as empty and has no tokens; rows are
independent, so repeated rows give repeated results; other columns pass through,
except that the added columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the splitting pattern whose cuts are known.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of common scripts, and marks that are no letters, digits or white space in any edition of the tables.
LETTER = "A-Za-zÀ-ÖØ-öø-žΑ-ΡΣ-Ωα-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
MARK = r"!-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞、-〃〈-】！-／：-＠"
#: Where a match of that pattern always ends, as no alternative holds both characters of such a pair next to each
#: other: after a letter, mark or digit before white space, after a letter before a mark or digit, after a digit
#: before a letter or mark, and after a mark (but an apostrophe) before a letter or digit.
FIXED_CUT = re.compile(rf"(?<=[{LETTER}{MARK}0-9])(?=[ \t\n\r　])|(?<=[{LETTER}])(?=[{MARK}0-9])|(?<=[0-9])(?=[{LETTER}{MARK}])|(?<=[{MARK}])(?<!')(?=[{LETTER}0-9])")
#: Other patterns have no known cuts: there a join encodes both halves again, as a whole.
NO_CUT = re.compile(r"(?!)")


class TreeBpe:
    """Encodes and decodes single texts as trees."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = 2048, leaf_tokens: int = 4096):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._width = {i: len(b) for b, i in ranks.items()}
        self._cuts = FIXED_CUT if pattern == KNOWN_PATTERN else NO_CUT
        self._leaf_chars, self._leaf_tokens = max(1, leaf_chars), max(1, leaf_tokens)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self._leaf_chars:
            return self._bpe.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        reach = 16
        while True:
            start, end = max(lo, mid - reach), min(hi, mid + reach)
            cuts = [start + m.start() for m in self._cuts.finditer(text[start:end])]
            before = max((c for c in cuts if start < c <= mid), default=None)
            after = min((c for c in cuts if mid <= c < end), default=None)
            a = before if before is not None else lo if start == lo else None
            b = after if after is not None else hi if end == hi else None
            if a is not None and b is not None:
                n_left = self._tokens_over(reversed(left), text[a:mid])
                n_right = self._tokens_over(right, text[mid:b])
                if n_left is not None and n_right is not None:
                    window = self._bpe.encode_ordinary(text[a:b]) if a < b else []
                    return left[: len(left) - n_left] + window + right[n_right:]
            reach *= 2

    def _tokens_over(self, tokens, part: str) -> int | None:
        """How many of these tokens make up the part; None if none of their borders is there."""
        rest, n = len(part.encode()), 0
        if rest:
            for t in tokens:
                rest, n = rest - self._width[t], n + 1
                if rest <= 0:
                    break
        return None if rest else n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self._leaf_tokens:
            return self._bpe.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def with_tokens(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", leaf_chars: int = 2048, decode: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and, if asked, ``decoded`` (bytes).

    ``ranks_path`` is a rank file that every worker can open. There is no shuffle,
    and a task holds one Arrow batch at a time.
    """
    added = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"decoded": T.BinaryType()} if decode else {})
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(k, t) for k, t in added.items())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(ranks_path, pattern, leaf_chars)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [bpe.encode(t or "") for t in batch.column("__text").to_pylist()]
                arrays = [batch.column(n) for n in names]
                arrays.append(pa.array([len(x) for x in ids], pa.int64()))
                arrays.append(pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()))
                if decode:
                    arrays.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)
