"""Language-model scoring by Katz backoff.

Tokens are the words of a text in lower case, then one end. The model of order k is

* ``P_k(w | h) = d_r c(h, w) / c(h)`` for n-grams seen r times in training, and
* ``P_k(w | h) = a(h) P_{k-1}(w | h')`` for others, with h' the history without its first word,

where d_r are Good-Turing discounts of that order and a(h) is what the seen n-grams leave over,
divided by the ``P_{k-1}`` of all words not seen after h: sums over w are exactly 1. P_0
is even over the training words and one unknown word. Before a text's first word stand ends.
All words and n-grams count as they are; none is merged, cut off or left out.

Words are 64-bit hashes, those with over ``N / FREQUENT`` of the tokens (and so ``FREQUENT`` at most)
small numbers; histories are hashes of words. Orders follow each other. In each, tasks send
the distinct n-grams of a chunk of texts, with their counts and the P of the order below,
to buckets by history; a bucket adds up counts and keeps the n-grams and who asked for them as
one row of a stored table. From all rows come the counts of counts and so the discounts; then
each row is turned into probabilities, which go back to the chunks. The bytes sent grow with
the n-grams, not with the number of buckets. Histories with over ``N / SPLIT`` of the tokens (and at most
``2 * SPLIT`` in all) are dealt to all buckets by the whole n-gram; only their sums are
gathered. The table of chunks is bucketed, so only answers move to meet it. Memory is that of a
chunk or a bucket of some million n-grams.

Defined results: a null text counts as empty (one end token); a null ``doc_id`` counts
as an empty id where it is hashed; repeated rows are scored one by one and each is
learnt from; without training texts base probabilities are 1 and the model knows the
unknown word only (score 0); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import new_path, stored

#: Words of the longest n-grams, unless the caller says otherwise.
ORDER = 2
#: Counts up to which Good-Turing discounts apply, and up to which counts of counts are gathered for their fit.
TOP, FITTED = 5, 64
#: Tokens of a chunk of texts, and n-grams of a bucket, about.
CHUNK, BUCKET = 1_000_000, 1_000_000
#: Histories with more than this part of all tokens are dealt to all buckets, words with more than that are numbered.
SPLIT, FREQUENT = 500, 1 << 16
#: Marks the 32 bits of a word that has no number.
RARE = np.uint32(1 << 31)

MIX = np.uint64(0x9E3779B97F4A7C15)
SENT = "bucket int, chunk long, h binary, w binary, n binary, p binary"
KEPT = "bucket int, h binary, w binary, c binary, p binary, asked array<struct<chunk:long,at:binary>>, seen array<long>, types long, hot array<struct<h:long,sums:array<double>>>"
ANSWERS = "level int, bucket int, chunk long, values binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def packed(x: np.ndarray, kind: str, rising: bool = False) -> bytes:
    """Byte planes (of the differences, where a sequence rises), compressed; doubles as they are, since few differ."""
    import zstandard

    x = x.astype(kind)
    x = np.diff(x, prepend=np.zeros(1, kind)) if rising else x
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes() if kind == "<f8" else x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def unpacked(b: bytes, kind: str, rising: bool = False) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    if kind == "<f8":
        return np.frombuffer(raw, kind)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def tokens_of(raw: bytes) -> list[bytes]:
    """Words without the end; of bytes, lower() and split() know A-Z and the ASCII spaces only."""
    return raw.lower().split()


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def encoded(docs: DataFrame) -> DataFrame:
    """A row per chunk: ids and lengths of its texts, its distinct words as ``words``, and its tokens as places in them."""
    schema = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, words binary, codes binary"
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            plain = np.concatenate(codes)
            order = np.argsort(-np.bincount(plain), kind="stable")  # frequent words first: small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            words = np.fromiter(map(word_hash, place), np.uint64, len(place))[order]
            row = [(part << 32) + nth, ids, held, lengths, packed(words, "<u8"), packed(rank[plain], "<u4")]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["chunk", "doc_ids", "held", "lengths", "words", "codes"])

        def numbered() -> defaultdict:
            new: defaultdict[bytes, int] = defaultdict()
            new.default_factory = new.__len__
            return new

        place = numbered()
        ids, held, lengths, codes, n = [], [], [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for raw in pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist():
                    tokens = [*tokens_of(raw), b""]
                    codes.append(np.fromiter(map(place.__getitem__, tokens), np.uint32, len(tokens)))
                    lengths.append(len(tokens))
                    n += len(tokens)
                ids += batch.column("doc_id").to_pylist()
                held += batch.column("held_out").to_pylist()
                if n >= CHUNK:
                    yield flush()
                    nth, n = nth + 1, 0
                    place = numbered()
                    ids, held, lengths, codes = [], [], [], []
        if ids:
            yield flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


@dataclass
class Level:
    """What all tasks know of one order: bounded facts."""

    k: int
    n_buckets: int
    #: Histories that are dealt to all buckets, sorted; and, once all is counted, their sums.
    hot: np.ndarray
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, TOP + 2)))
    discounts: np.ndarray = field(default_factory=lambda: np.ones(TOP + 2))
    #: Training tokens and words (the latter of order 1 only).
    n: int = 0
    v: int = 0
    #: Hashes of the numbered words, sorted, and their P_1.
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    p: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def packed_p(self, w: np.ndarray, p: np.ndarray) -> bytes:
        """P of the order below; that of numbered words is known where it is that of words."""
        return packed(p[w >= RARE] if self.k == 2 else p, "<f8")

    def unpacked_p(self, w: np.ndarray, b: bytes) -> np.ndarray:
        p = unpacked(b, "<f8")
        if self.k == 2:
            whole, rare = np.empty(len(w)), w >= RARE
            whole[~rare], whole[rare] = self.p[w[~rare]], p
            return whole
        return p


class Chunk:
    """A chunk's tokens: places in the table of its distinct words."""

    def __init__(self, row):
        self.words, self.codes = unpacked(row.words, "<u8"), unpacked(row.codes, "<u4")
        self.lengths = np.array(row.lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.learnt = np.repeat(~np.array(row.held, bool), self.lengths)

    def before(self, back: int) -> np.ndarray:
        """The codes of the words that stand so far before; the end before a text's first."""
        here = np.arange(len(self.codes))
        end = np.uint32(np.flatnonzero(self.words == np.uint64(word_hash(b"")))[0])
        return np.where(here - back >= np.repeat(self.ends - self.lengths, self.lengths), self.codes[np.maximum(here - back, 0)], end)

    def ids(self, frequent: np.ndarray) -> np.ndarray:
        """Numbers of frequent words, marked hashes of others."""
        at = np.minimum(np.searchsorted(frequent, self.words), max(0, len(frequent) - 1))
        known = frequent[at] == self.words if len(frequent) else np.zeros(len(self.words), bool)
        return np.where(known, at.astype(np.uint64), self.words | np.uint64(1 << 63))

    def histories(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct histories of k - 1 words, and for each token which one it has."""
        if k == 2:
            return ids, self.before(1)
        h = np.full(len(self.codes), k, np.uint64)
        for back in range(k - 1, 0, -1):
            h = mixed(h ^ ids[self.before(back)])
        return np.unique(h, return_inverse=True)


def ranked(*keys: np.ndarray) -> np.ndarray:
    """The place of each in the order by these keys, the last first."""
    order = np.lexsort(keys)
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    return rank


class Grams:
    """The distinct n-grams of a chunk, in the order of buckets, histories and words. Those of one word have it as ``h``."""

    def __init__(self, chunk: Chunk, level: Level):
        of_bucket = lambda x: (mixed(x) >> np.uint64(20)) % np.uint64(level.n_buckets)
        if level.k == 1:
            bucket = of_bucket(chunk.words)
            order = np.lexsort((chunk.words, bucket))
            self.h, self.w, self.bucket = chunk.words[order], np.zeros(len(order), np.uint32), bucket[order]
            self.n = np.bincount(chunk.codes, chunk.learnt, len(order)).astype(np.int64)[order]
            self._of = np.argsort(order)[chunk.codes]
            return
        ids = chunk.ids(level.frequent)
        w = np.where(ids >> np.uint64(63), (ids >> np.uint64(32)).astype(np.uint32) | RARE, ids.astype(np.uint32))
        each, history = chunk.histories(ids, level.k)
        hot, h_bucket, w_bucket = np.isin(each, level.hot), of_bucket(each), of_bucket(ids)
        bucket = np.where(hot[history], w_bucket[chunk.codes], h_bucket[history])
        names, place = np.unique(bucket, return_inverse=True)
        keys = ranked(w)[chunk.codes], ranked(each)[history], place.astype(np.uint64)
        bits = [int(x).bit_length() for x in (len(w), len(each), len(names))]
        if sum(bits) <= 64:
            key = keys[2] << np.uint64(bits[0] + bits[1]) | keys[1] << np.uint64(bits[0]) | keys[0]
        else:  # a very long text, with millions of distinct words
            order = np.lexsort(keys)
            key = np.empty(len(order), np.uint64)
            key[order] = np.cumsum(np.any([np.diff(x[order].astype(np.int64), prepend=-1) != 0 for x in keys], axis=0))
        _, self.first, self._of = np.unique(key, return_index=True, return_inverse=True)
        self.h, self.w, self.bucket = each[history[self.first]], w[chunk.codes[self.first]], bucket[self.first]
        self.n = np.bincount(self._of, chunk.learnt, len(self.h)).astype(np.int64)

    def by_token(self, values: np.ndarray) -> np.ndarray:
        """Values of the distinct n-grams, in their order here, for every token."""
        return values[self._of]

    def messages(self, chunk: int, p: np.ndarray, level: Level) -> list[tuple]:
        starts = np.flatnonzero(np.diff(self.bucket.astype(np.int64), prepend=-1))
        out = []
        for own in (slice(a, b) for a, b in zip(starts, [*starts[1:], len(self.bucket)], strict=True)):
            out.append((int(self.bucket[own.start]), chunk, packed(self.h[own], "<u8", True), packed(self.w[own], "<u4"), packed(self.n[own], "<u4"), level.packed_p(self.w[own], p[own])))
        return out


def first_messages(chunks: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                grams = Grams(Chunk(row), level)
                made = pd.DataFrame(grams.messages(row.chunk, np.zeros(len(grams.h)), level), columns=["bucket", "chunk", "h", "w", "n", "p"])
                yield pa.RecordBatch.from_pandas(made.astype({"bucket": "int32"}), preserve_index=False)

    return chunks.mapInArrow(run, SENT)


def counted(messages: DataFrame, level: Level) -> DataFrame:
    """The stored n-gram table of one order, a row per bucket."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes, parts = [], ([], [], [], [])
        for r in rows.itertuples():
            own = unpacked(r.w, "<u4")
            for to, x in zip(parts, (unpacked(r.h, "<u8", True), own, unpacked(r.n, "<u4"), level.unpacked_p(own, r.p)), strict=True):
                to.append(x)
            sizes.append(len(parts[0][-1]))
        h, w, n, p = (np.concatenate(x) for x in parts)
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        c = np.bincount(of, n, len(first)).astype(np.int64)
        h, w, p = h[first], w[first], p[first]
        asked = [{"chunk": int(chunk), "at": packed(x, "<u4", True)} for chunk, x in zip(rows["chunk"], np.split(of, np.cumsum(sizes)[:-1]), strict=True)]
        hot = []
        for x in level.hot:
            # words as they are have the one empty history
            own = slice(*np.searchsorted(h, [x, x + np.uint64(1)])) if level.k > 1 else slice(0, len(h))
            if own.stop > own.start:
                hot.append({"h": int(x.astype(np.int64)), "sums": history_sums(np.zeros(own.stop - own.start, np.int64), c[own], p[own], 1)[0].tolist()})
        seen = np.bincount(np.minimum(c, FITTED + 1), minlength=FITTED + 2)
        return pd.DataFrame([(key[0], packed(h, "<u8", True), packed(w, "<u4"), packed(c, "<u8"), level.packed_p(w, p), asked, seen[: FITTED + 1].tolist(), int((c > 0).sum()), hot)], columns=["bucket", "h", "w", "c", "p", "asked", "seen", "types", "hot"])

    return stored(messages.groupBy("bucket").applyInPandas(merge, KEPT), f"grams-{level.k}")


def history_sums(of: np.ndarray, c: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Per history: its count, the n-grams seen 1 to ``TOP`` times, and the lower order's P of its seen words."""
    return np.stack([np.bincount(of, c, n), *(np.bincount(of, c == r, n) for r in range(1, TOP + 1)), np.bincount(of, np.where(c > 0, p, 0.0), n)], axis=1)


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's discounts of the counts 0 to TOP + 1, from the number of n-grams seen r times.

    Good-Turing estimates need smooth counts of counts: each is spread over the gap to its
    neighbours and a line is fitted to their logarithms. The slope is at most -1.1 (beyond -1
    discounts would not be proper) and -2 where there are too few points for a line.
    """
    r = np.array([k for k in range(1, len(seen)) if seen[k] > 0], float)
    slope = -2.0
    if len(r) > 1:
        before, after = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
        z = np.array([seen[int(k)] for k in r]) / ((after - before) / 2)
        slope = min(float(np.polyfit(np.log(r), np.log(z), 1, w=np.sqrt(z))[0]), -1.1)
    of = lambda x: ((x + 1) / x) ** (slope + 1)  # noqa: E731  of r*/r
    common = (TOP + 1) ** (slope + 1)
    k = np.arange(1, TOP + 1)
    return np.concatenate([[1.0], (of(k) - common) / (1 - common), [1.0]])


def probabilities(of: np.ndarray, c: np.ndarray, p: np.ndarray, sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P of n-grams with these histories (rows of ``sums``), counts, and P of the order below."""
    total, lower = sums[:, 0], sums[:, -1]
    kept = total - sum((1 - d[r]) * r * sums[:, r] for r in range(1, TOP + 1))
    # where nothing is left over, one more count for what is unseen; that includes the unknown word always
    by = np.maximum(np.where(kept > total * (1 - 1e-9), total + 1, total), 1)
    weight = np.where(total == 0, 1.0, (1 - kept / by) / np.maximum(1 - lower, 1e-12))
    return np.where(c > 0, d[np.minimum(c, TOP + 1)] * c / by[of], weight[of] * p)


def completed(table: DataFrame, level: Level, n: int) -> Level:
    """The level with its discounts and the sums of its hot histories."""
    seen = table.select(F.posexplode("seen").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    types = table.agg(F.sum("types")).first()[0] or 0
    by_count = [0] * (FITTED + 2)
    for row in seen:
        by_count[row.r] = row.n
    sums = table.select(F.explode("hot").alias("x")).select("x.h", F.posexplode("x.sums").alias("at", "v")).groupBy("h", "at").agg(F.sum("v").alias("v")).collect()
    gathered = np.zeros((len(level.hot), TOP + 2))
    for row in sums:
        gathered[np.searchsorted(level.hot, np.array([row.h], np.int64).view(np.uint64)[0]), row.at] = row.v
    if level.k == 1:
        gathered[:, -1] = types / (types + 1)
    return replace(level, sums=gathered, discounts=discounts(by_count[: FITTED + 1]), n=n, v=types)


def answers(table: DataFrame, known: Level, kind: str) -> DataFrame:
    """For every chunk and bucket the values that the chunk asked for: counts (of ``kind`` <u8), or P of this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            c = unpacked(row["c"], "<u8").astype(np.int64)
            if kind == "<u8":
                values = c
            else:
                h = unpacked(row["h"], "<u8", True)
                each, of = np.unique(h, return_inverse=True)
                p = known.unpacked_p(unpacked(row["w"], "<u4"), row["p"])
                sums = history_sums(of, c, p, len(each))
                hot = np.isin(each, known.hot)
                sums[hot] = known.sums[np.searchsorted(known.hot, each[hot])]
                values = probabilities(of, c, p, sums, known.discounts)
            out = [(known.k, row["bucket"], a["chunk"], packed(values[unpacked(a["at"], "<u4", True)], kind)) for a in row["asked"]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["level", "bucket", "chunk", "values"]).astype({"level": "int32", "bucket": "int32"}), preserve_index=False)

    return table.mapInArrow(run, ANSWERS)


def received(rows: pd.DataFrame, level: int, kind: str) -> np.ndarray:
    own = rows[rows["level"] == level].sort_values("bucket")
    return np.concatenate([unpacked(b, kind) for b in own["values"]])


def word_probabilities(c: np.ndarray, level: Level) -> np.ndarray:
    """P_1 of words with these counts, over an even P_0."""
    even = np.full(len(c), 1 / (level.v + 1))
    return probabilities(np.zeros(len(c), np.int64), c, even, level.sums, level.discounts)


def next_messages(chunks: DataFrame, answered: DataFrame, before: Level, now: Level) -> DataFrame:
    """What chunks send for the next order, from what they were told of the order below."""

    def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for row in own.itertuples():
            chunk = Chunk(row)
            if before.k == 1:
                p = word_probabilities(received(told, 1, "<u8").astype(np.int64), before)
            else:
                p = received(told, before.k, "<f8")
            p = Grams(chunk, before).by_token(p)
            grams = Grams(chunk, now)
            out += grams.messages(row.chunk, p[grams.first], now)
        return pd.DataFrame(out, columns=["bucket", "chunk", "h", "w", "n", "p"])

    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(run, SENT)


def scored(chunks: DataFrame, answered: DataFrame, first: Level, last: Level) -> DataFrame:
    """The figures of each text, from the counts of its words and the P of its longest n-grams."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples():
            chunk = Chunk(row)
            grams = Grams(chunk, first)
            counts = received(told, 1, "<u8").astype(np.int64)
            c = grams.by_token(counts)
            base = np.log10((c + 0.1) / (first.n + 0.1 * (first.v + 1)))
            if last.k == 1:
                p = grams.by_token(word_probabilities(counts, first))
            else:
                p = Grams(chunk, last).by_token(received(told, last.k, "<f4")).astype(float)
            starts = np.append(0, chunk.ends[:-1])
            add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has an end, so none is empty
            out.append(pd.DataFrame({"doc_id": pd.array(row.doc_ids, "Int64"), "held_out": row.held, "n_tokens": row.lengths, "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(run, schema)


def hot_histories(chunks: DataFrame, n: int, k: int, frequent: np.ndarray) -> np.ndarray:
    """Histories with over ``n / SPLIT`` training tokens, and at most ``2 * SPLIT`` in all.

    A chunk tells those with over a part of 4 * SPLIT of its own tokens. What it leaves out is at
    most a quarter of the threshold in all, so hot ones have half of it among what is told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                chunk = Chunk(row)
                each, history = chunk.histories(chunk.ids(frequent), k)
                h, c = each, np.bincount(history, chunk.learnt, len(each)).astype(np.int64)
                many = 4 * SPLIT * c > chunk.learnt.sum()
                yield pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64), pa.int64()), pa.array(c[many], pa.int64())], names=["h", "c"])

    told = chunks.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") * 2 * SPLIT > n)
    return np.sort(np.array([r.h for r in told.collect()], np.int64).view(np.uint64))


def frequent_words(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with over ``n / FREQUENT`` tokens, sorted by hash; there can't be more than ``FREQUENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            c = unpacked(row["c"], "<u8").astype(np.int64)
            many = c > n / FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(row["h"], "<u8", True)[many].view(np.int64), pa.int64()), pa.array(c[many], pa.int64())], names=["h", "c"])

    found = table.select("h", "c").mapInArrow(run, "h long, c long").toArrow()
    h, c = np.array(found.column("h").to_pylist(), np.int64).view(np.uint64), np.array(found.column("c").to_pylist(), np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def in_buckets(df: DataFrame, by: str) -> DataFrame:
    """Write a table bucketed by a column, so that it need not be shuffled to meet others by it."""
    spark, name = df.sparkSession, f"folio_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, by).option("path", new_path(spark, "chunks")).saveAsTable(name)
    return spark.table(name)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows are held out from training if crc32 of their id, as text, is 0 modulo 10.
    """
    number = F.col(id_col).cast("long")
    docs = df.select(number.alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.crc32(F.coalesce(number.cast("string"), F.lit(""))) % 10 == 0).alias("held_out"))
    chunks = in_buckets(encoded(docs), "chunk")
    each = chunks.select(F.explode(F.arrays_zip("held", "lengths")).alias("x")).agg(F.sum("x.lengths").alias("tokens"), F.sum(F.when(~F.col("x.held"), F.col("x.lengths"))).alias("n")).first()
    n, n_buckets = each.n or 0, max(16, -(-(each.tokens or 0) // BUCKET))
    words = level = Level(1, n_buckets, np.array([1], np.uint64))  # the one empty history is dealt to all buckets
    table = counted(first_messages(chunks, level), level)
    words = level = completed(table, level, n)
    counts = answered = answers(table, level, "<u8")
    frequent, c = frequent_words(table, n)
    for k in range(2, order + 1):
        above = Level(k, n_buckets, hot_histories(chunks, n, k, frequent), frequent=frequent, p=word_probabilities(c, words))
        table = counted(next_messages(chunks, answered, level, above), above)
        level = completed(table, above, n)
        answered = answers(table, level, "<f8" if k < order else "<f4")
    told = counts if order == 1 else counts.unionByName(answered)
    return scored(chunks, told, words, level).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
