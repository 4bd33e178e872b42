"""Alignment of two tokenizers over the same texts, by deduplicated segments.

A is a byte-level BPE that reads space and text, B a piece model that adds that space itself. Both
give tokens that cover bytes; where tokens of both end, bytes are cut into groups, and all
occurrences of A and B in a group are linked.

Texts are split before runs of white space, where no entry of either vocabulary goes on from
something else to that white space (``cuts`` looks at every entry), so no merge crosses and the
tokens of a text are those of its segments in a row. Steps:

1. Tasks read texts in chunks and number each chunk's distinct segments; texts become numbers.
2. Segments meet by value: each distinct one is tokenised and aligned once, and its alignment goes
   back to the chunks that hold it, as columns per chunk.
3. A chunk composes its texts from alignments, and counts in how many of them each pair is linked.
4. Pair counts are added up over all chunks, ids of A learn their highest (a table no longer than
   A's vocabulary), and both go back to the chunks, where the texts' links look them up.

Memory is that of a chunk (``CHUNK_BYTES`` of text, or one longer text), or of a block of a partition's
segments. What is sent grows with the distinct segments of chunks, not with chunks times partitions.

Defined results: null and empty texts have no tokens (zeros and ''), and so have texts whose tokens' bytes
differ from space and text (those that hold U+2581, say); texts without tokens count for no pair; a null
``doc_id`` passes through; repeated rows are documents of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import per_worker, stored

#: Bytes of text in a chunk, and segments that are aligned together.
CHUNK_BYTES, BLOCK = 1 << 26, 20_000
SPACE = "▁"
#: White space before which a cut may be tried.
BREAKS = " \t\n\r\x0b\x0c"

READ = "kind int, chunk long, doc_id long, codes binary, segment string, nth int"
SENT = "chunk long, figures binary, pairs binary, groups binary"
MADE = "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, nth int, a int, b int, n long"
DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def a_bytes(path: str) -> dict[int, bytes]:
    """The bytes of A's entries; refuses files that change texts or don't split them as the cuts need it."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made["pre_tokenizer"] or {}
    if made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        raise ValueError(f"{path} is no plain byte-level tokenizer")
    letters = byte_letters()
    return {i: bytes(letters[c] for c in entry) for entry, i in made["model"]["vocab"].items()}


def b_bytes(path: str) -> list[bytes]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode() for i in range(m.get_piece_size())]


def cuts(a: dict[int, bytes], b: Sequence[bytes]) -> str:
    """The white space before which no merge of either vocabulary crosses: no entry goes on to it from anything that is
    no white space, and of other than spaces B has no entry but the byte itself (so B's own space stays apart)."""
    texts = [x.decode("utf-8", "replace") for x in (*a.values(), *b)]
    crossed = {x[k] for x in texts for k in range(1, len(x)) if x[k] in BREAKS and not x[k - 1].isspace()}
    in_b = {c for x in b if len(x) > 1 for c in x.decode("utf-8", "replace")}
    return "".join(c for c in BREAKS if c not in crossed and (c == " " or c not in in_b))


def splitter(breaks: str) -> re.Pattern:
    """Segments of a text; white space run by run, a run that may not be cut off stays inside."""
    if not breaks:
        return re.compile(r"(?s:.+)")
    return re.compile(rf"\s*\S+(?:[^\S{re.escape(breaks)}]\s*\S*)*|\s+")


def squeezed(x: np.ndarray) -> bytes:
    """An array's byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(x.size, -1).T.tobytes()) if x.size else b""


def restored(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Aligner:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = a_bytes(a_path), b_bytes(b_path)
        self.space = self.b.piece_to_id(SPACE)

    def align(self, segments: Sequence[str]) -> Iterator[tuple[bool, list[list[int]], list[list[int]]]]:
        """Of each segment whether its bytes are kept, and the ids of A and of B in each of its groups."""
        firsts = [s[1:] if s[0] == " " else s for s in segments]
        for s, x, b in zip(segments, self.a.encode_batch_fast(list(segments), add_special_tokens=False), self.b.encode(firsts, num_threads=1), strict=True):
            a = x.ids
            if s == " ":
                b = [self.space]  # B adds none to nothing
            elif s[0] != " " and b[:1] == [self.space]:
                b = b[1:]  # B's own space, which stands only before the text
            a_parts, b_parts, raw = [self.a_bytes.get(i, b"") for i in a], [self.b_bytes[i] for i in b], s.encode()
            if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
                yield False, [], []
                continue
            if len(a) == 1 or len(b) == 1:
                yield True, [a], [b]
                continue
            a_groups, b_groups, at_a, at_b, k = [], [], 0, 0, 0
            from_a, from_b = 0, 0
            for j, part in enumerate(a_parts, 1):
                at_a += len(part)
                while at_b < at_a:
                    at_b += len(b_parts[k])
                    k += 1
                if at_a == at_b:
                    a_groups.append(a[from_a:j])
                    b_groups.append(b[from_b:k])
                    from_a, from_b = j, k
            yield True, a_groups, b_groups


def chunked(docs: DataFrame, breaks: str) -> DataFrame:
    """Documents as numbers of their chunk's segments (kind 0), and those segments (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, nth = splitter(breaks).findall, TaskContext.get().partitionId(), 0
        schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("segment", pa.string()), ("nth", pa.int32())])

        def numbered() -> defaultdict[str, int]:
            made: defaultdict[str, int] = defaultdict()
            made.default_factory = made.__len__
            return made

        def made(chunk: int) -> Iterator[pa.RecordBatch]:
            segments = list(place)
            for at in range(0, len(segments), 50_000):
                some = segments[at : at + 50_000]
                n, k = len(some), np.arange(at, at + len(some), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 1, np.int32)), pa.array(np.full(n, chunk)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(some), pa.array(k)], schema=schema)

        place, size = numbered(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, codes, chunk = whole.slice(at, 256), [], (part << 32) + nth
                for text in batch.column("text").to_pylist():
                    found = split(" " + text) if text else []
                    codes.append(squeezed(np.fromiter(map(place.__getitem__, found), np.uint32, len(found))))
                    size += len(text or "")
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, chunk)), batch.column("doc_id"), pa.array(codes, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], schema=schema)
                if size >= CHUNK_BYTES:
                    yield from made(chunk)
                    place, size, nth = numbered(), 0, nth + 1
        yield from made((part << 32) + nth)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, READ)


def aligned(segments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignments for chunks: equal segments come in a row, and the first of them is tokenised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool: Aligner = per_worker("aligner", a_path + "\n" + b_path, lambda: Aligner(a_path, b_path))
        held: dict[int, tuple[list, list, list]] = {}
        size, last, told = 0, None, None

        def told_of(one: tuple[bool, list, list]) -> tuple:
            ok, a, b = one
            text = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in zip(a, b, strict=True)])
            pairs = [i << 32 | j for x, y in zip(a, b, strict=True) for i in x for j in y]
            return (ok, sum(map(len, a)), sum(map(len, b)), len(a), len(pairs)), pairs, text

        def flush() -> Iterator[pa.RecordBatch]:
            zip_ = zstandard.ZstdCompressor(level=1).compress
            rows = [(c, squeezed(np.array(f, np.uint32).T.copy().ravel()), squeezed(np.array(p, np.uint64)), zip_("\n".join(g).encode())) for c, (f, p, g) in held.items()]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "figures", "pairs", "groups"])

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                values = batch.column("segment").to_pylist()
                new = [s for s, before in zip(values, [last, *values], strict=False) if s != before]
                made = map(told_of, tool.align(new))
                for s, chunk, nth in zip(values, batch.column("chunk").to_pylist(), batch.column("nth").to_pylist(), strict=True):
                    if s != last:
                        last, told = s, next(made)
                    figures, pairs, text = held.setdefault(chunk, ([], [], []))
                    figures.append((nth, *told[0]))
                    pairs += told[1]
                    text.append(told[2])
                size += batch.num_rows
                if size >= 250_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return segments.select("chunk", "segment", "nth").repartition("segment").sortWithinPartitions("segment").mapInArrow(run, SENT)


class Chunk:
    """A chunk's alignments: of each segment its figures, its pairs and its groups as text."""

    def __init__(self, blocks: Sequence[tuple[bytes, bytes, bytes]]):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        figures = [restored(f, "u4").reshape(6, -1) for f, _, _ in blocks]
        pairs = [restored(p, "u8") for _, p, _ in blocks]
        texts = [t for _, _, g in blocks for t in unzip(g).decode().split("\n")]
        all_figures = np.concatenate(figures, 1).astype(np.int64) if figures else np.zeros((6, 0), np.int64)
        order = np.argsort(all_figures[0])
        self.ok, self.n_a, self.n_b, self.n_groups, self.n_pairs = all_figures[1:, order]
        self.text = [texts[k] for k in order]
        first = (np.cumsum(all_figures[5]) - all_figures[5])[order]
        every = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
        self.pair_ids, code = np.unique(every, return_inverse=True)
        self.pairs = code[ranges(first, self.n_pairs)].astype(np.int64)
        self.first = np.cumsum(self.n_pairs) - self.n_pairs
        self.docs_with = np.zeros(len(self.pair_ids), np.int64)

    def compose(self, codes: np.ndarray) -> tuple:
        """A document's figures, the hash of its groups, and its links as pairs and how often each."""
        if not len(codes) or not self.ok[codes].all():
            return 0, 0, 0, 0, "", b""
        distinct, often = np.unique(codes, return_counts=True)
        at = ranges(self.first[distinct], self.n_pairs[distinct])
        pairs, where = np.unique(self.pairs[at], return_inverse=True)
        links = np.bincount(where, np.repeat(often, self.n_pairs[distinct])).astype(np.uint32)
        self.docs_with[pairs] += 1
        sha = hashlib.sha256(";".join([self.text[k] for k in codes.tolist()]).encode()).hexdigest()
        packed = squeezed(np.concatenate([np.diff(pairs, prepend=0).astype(np.uint32), links]))
        return int(self.n_a[codes].sum()), int(self.n_b[codes].sum()), int(self.n_groups[codes].sum()), int(links.sum(dtype=np.int64)), sha, packed


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of first[1] and so on."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def composed(docs: DataFrame, alignments: DataFrame) -> DataFrame:
    """Documents with figures and links (kind 0), and the pairs of each chunk (kind 1)."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = [c.split(" ")[0] for c in MADE.split(", ")]

    def batch_of(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, chunk = None, [], None

        def pairs_of() -> Iterator[pa.RecordBatch]:
            if chunk is not None and len(chunk.pair_ids):
                k = np.flatnonzero(chunk.docs_with)
                ids = chunk.pair_ids[k]
                yield batch_of(len(k), {"kind": np.ones(len(k), np.int32), "chunk": np.full(len(k), now), "nth": k.astype(np.int32), "a": (ids >> np.uint64(32)).astype(np.int32), "b": (ids & np.uint64(0xFFFFFFFF)).astype(np.int32), "n": chunk.docs_with[k]})

        for batch in batches:
            rows: list[tuple] = []
            for key, kind, doc_id, codes, figures, pairs, groups in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "doc_id", "codes", "figures", "pairs", "groups")), strict=True):
                if key != now:
                    yield from pairs_of()
                    now, blocks, chunk = key, [], None
                if kind == 0:
                    blocks.append((figures, pairs, groups))
                    continue
                if chunk is None:
                    chunk, blocks = Chunk(blocks), []
                rows.append((key, doc_id, *chunk.compose(restored(codes, "u4"))))
            if rows:
                yield batch_of(len(rows), {"kind": np.zeros(len(rows), np.int32)} | dict(zip(("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"), map(list, zip(*rows, strict=True)), strict=True)))
        yield from pairs_of()

    both = alignments.withColumn("kind", F.lit(0)).unionByName(docs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").select("chunk", "kind", "doc_id", "codes", "figures", "pairs", "groups").mapInArrow(run, MADE)


def counted(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents with what the corpus-wide counts of their links say."""
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = total.groupBy("a").agg(F.max("total").alias("highest"))  # as long as A's vocabulary at most
    known = total.join(F.broadcast(highest), "a").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = pairs.select("chunk", "nth", "a", "b").join(known, ["a", "b"]).select("chunk", "nth", "total", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, total, best = None, [], None, None
        for batch in batches:
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(chunks) | np.diff(kinds)) + 1
            for at, end in zip([0, *edges.tolist()], [*edges.tolist(), len(chunks)], strict=True):
                if at == end:
                    continue
                part = batch.slice(at, end - at)
                if chunks[at] != now:
                    now, parts, total = chunks[at], [], None
                if kinds[at] == 0:
                    parts.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("nth", "total", "best")])
                    continue
                if total is None:
                    nth, sums, bests = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))
                    total, best = np.zeros(int(nth.max(initial=-1)) + 1, np.int64), np.zeros(int(nth.max(initial=-1)) + 1, np.int64)
                    total[nth], best[nth], parts = sums, bests, []
                found = []
                for raw in part.column("links").to_pylist():
                    steps, often = restored(raw, "u4").astype(np.int64).reshape(2, -1)
                    k = np.cumsum(steps)
                    found.append((int((best[k] * often).sum()), int((total[k] * often).sum())))
                n_best, count_sum = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), part.column(names[-1])], names=[*names[:-1], "n_best", "count_sum", names[-1]])

    both = answers.withColumn("kind", F.lit(0)).unionByName(docs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").select("chunk", "kind", "nth", "total", "best", "links", *names).mapInArrow(run, DONE)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document with its tokens, groups and links under both tokenizers."""
    breaks = cuts(a_bytes(a_path), b_bytes(b_path))
    read = stored(chunked(docs, breaks), "segments", by="kind")
    found = aligned(read.where("kind = 1"), a_path, b_path)
    made = stored(composed(read.where("kind = 0").select("chunk", "doc_id", "codes"), found), "alignments", by="kind")
    return counted(made.where("kind = 0").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"), made.where("kind = 1").select("chunk", "nth", "a", "b", "n"))
