"""Token-id files: one independent zstandard frame per document and a trailing seek table.

A shard is a file in the public *seekable* zstandard layout: frames, then one
skippable frame that lists each frame's compressed size, size and checksum (the low
32 bits of XXH64) and ends in a footer. Frame k holds the ids of document k of the
shard, as little-endian unsigned integers of 2 bytes (4, where the vocabulary needs
them). One more frame, the last, holds the shard's document ids. A reader seeks to the
footer, then decompresses only the frames that it was asked for, and checks each.

Texts are encoded where they lie, and only ids are put in order. Shards follow each other in
ascending ``doc_id`` order, nulls first, and documents do so within them; equal ids are
ordered by a hash of the text, so even one id of many rows is dealt to several shards. Each
task writes its shard under a name of its own and renames it when whole, so a task that runs
twice leaves one shard.

Defined results: a null text counts as empty and has the end id only; an empty table
gives no shard; repeated rows give repeated documents; other columns are not written.
"""

from __future__ import annotations

import gc
import json
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import per_worker, stored

# Fixed values of the public seekable layout.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
FOOTER = "<IBI"
FOOTER_SIZE = struct.calcsize(FOOTER)

MANIFEST = "shard int, n_docs long, n_ids long, width int"
#: Distinct words whose ids a worker remembers; beyond it the memory starts anew.
MEMO_WORDS = 500_000


def open_folder(uri: str):
    """A file system and a path in it, on the driver and on executors alike."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))
    return system, path.rstrip("/")


#: Words of visible ASCII (no special token's brackets) and Latin-1 letters: they are in
#: normal form C, and lower case goes letter by letter.
PLAIN = r"[!-;=?-~À-ÖØ-öø-ÿ]+"
#: How the tokenizer's pattern splits such a word in lower case.
PLAIN_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"


#: The settings of a tokenizer file for which words can be looked up one by one. Fixed values of that file.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
    "post_processor": None,
}


def encodes_by_word(settings: dict) -> bool:
    """Whether a tokenizer file has exactly these settings, and no added token that a word without brackets could hold."""
    plain = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings.get("added_tokens") or [])
    return plain and settings["model"]["type"] == "BPE" and all(settings.get(k) == v for k, v in BY_WORD.items())


class WordIds:
    """Ids of texts by a tokenizer file.

    Where its settings are those of ``BY_WORD``, the parts between ASCII spaces are independent, so each
    distinct part goes through the tokenizers library once. Plain words are lowered and
    split here and their pieces go to the library's model; all others take its whole
    path. The memory has two generations, so that frequent words outlive rare ones. With any
    other settings the library encodes whole texts.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            self._by_word = encodes_by_word(json.load(f))
        self.width = 2 if max(self._tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self._pack = {2: struct.Struct("<H").pack, 4: struct.Struct("<I").pack}[self.width]
        self._end = self._pack(end_id)
        self._plain, self._parts = re.compile(PLAIN).fullmatch, re.compile(PLAIN_PARTS).findall
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._memo: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        own = piece if piece.isascii() else self._bytes(piece)[0][0]
        ids = b"".join([self._pack(t.id) for t in self._tokenizer.model.tokenize(own)])
        self._pieces[piece] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        memo, old, pieces = self._memo, self._old, self._pieces
        rest = []
        for w in words:
            if (known := old.get(w)) is not None:
                memo[w] = known
            elif self._plain(w):
                memo[w] = b"".join([pieces.get(x) or self._piece(x) for x in self._parts(w.lower())])
            else:
                rest.append(w)
        for w, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            memo[w] = b"".join(map(self._pack, e.ids))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        if not self._by_word:
            return [b"".join(map(self._pack, e.ids)) + self._end for e in self._tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self._memo) > MEMO_WORDS:
            self._old, self._memo = self._memo, {"": b""}
        if len(self._pieces) > MEMO_WORDS:
            self._pieces.clear()
        collecting = gc.isenabled()
        gc.disable()  # learning makes many small objects and no cycles
        try:
            self._learn(list(set().union(*parts).difference(self._memo)))
        finally:
            if collecting:
                gc.enable()
        ids = self._memo.__getitem__
        return [b"".join(map(ids, p)) + self._end for p in parts]


class ShardWriter:
    def __init__(self, sink, width: int):
        import xxhash
        import zstandard

        self._sink, self.width = sink, width
        self._pack = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self._check = xxhash.xxh64_intdigest
        self._entries: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []
        self.n_ids = 0

    def _frame(self, data: bytes) -> None:
        packed = self._pack(data)
        self._sink.write(packed)
        self._entries.append((len(packed), len(data), self._check(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self._ids.append(doc_id)
        self.n_ids += len(ids) // self.width

    def finish(self) -> int:
        known = np.array([x is not None for x in self._ids], np.uint8)
        self._frame(np.array([x or 0 for x in self._ids], "<i8").tobytes() + known.tobytes())
        table = np.array(self._entries, ENTRY).tobytes()
        self._sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + FOOTER_SIZE) + table)
        self._sink.write(struct.pack(FOOTER, len(self._entries), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        return len(self._ids)


@dataclass
class Shard:
    """A shard opened for reading: its seek table and document ids."""

    source: object
    width: int

    def __post_init__(self) -> None:
        import xxhash
        import zstandard

        self._unpack, self._check = zstandard.ZstdDecompressor().decompress, xxhash.xxh64_intdigest
        end = self.source.size()
        n, flags, magic = struct.unpack(FOOTER, self.source.read_at(FOOTER_SIZE, end - FOOTER_SIZE))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token file: its footer is damaged")
        at = end - FOOTER_SIZE - n * ENTRY.itemsize
        self.entries = np.frombuffer(self.source.read_at(n * ENTRY.itemsize, at), ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        ids = self._read(n - 1)
        self.n_docs = n - 1
        known = np.frombuffer(ids, np.uint8, offset=8 * self.n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(ids, "<i8", self.n_docs), known, strict=True)]
        self.n_tokens = self.entries["size"][: self.n_docs].astype(np.int64) // self.width

    def _read(self, k: int, packed: bytes | None = None) -> bytes:
        e = self.entries[k]
        packed = self.source.read_at(int(e["packed"]), int(self.offsets[k])) if packed is None else packed
        data = self._unpack(packed, max_output_size=int(e["size"]))
        if len(data) != e["size"] or self._check(data) & 0xFFFFFFFF != e["check"]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, k: int) -> bytes:
        """The ids of document k as little-endian unsigned 32-bit integers."""
        return np.frombuffer(self._read(k), f"<u{self.width}").astype("<u4").tobytes()


def with_ids(df: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """``doc_id, tie, width, ids``: the ids of each text as they are kept in files; ``tie`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("word ids", f"{tokenizer_path} {end_id}", lambda: WordIds(tokenizer_path, end_id))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                ids = encoder.encode(t or "" for t in part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([encoder.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "tie", "width", "ids"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, width int, ids binary")


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode ``doc_id, text`` rows and write them as shards into a new shared folder.

    Ids are dealt to tasks by ranges of ``doc_id``; each task writes one shard. The
    small manifest (a row per shard) is a Parquet table beside them.
    """
    system, path = open_folder(folder)
    system.create_dir(f"{path}/shards", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, own = open_folder(folder)
        draft = f"{own}/shards/_draft-{task.partitionId()}-{task.taskAttemptId()}"
        writer = sink = None
        for batch in batches:
            if writer is None and batch.num_rows:
                sink = out.open_output_stream(draft)
                writer = ShardWriter(sink, batch.column(1)[0].as_py())
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                writer.add(doc_id, ids)
        if writer is not None:
            n = writer.finish()
            sink.close()
            out.move(draft, f"{own}/shards/{task.partitionId():06d}.zst")
            row = [[task.partitionId()], [n], [writer.n_ids], [writer.width]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["shard", "n_docs", "n_ids", "width"])

    rows = stored(with_ids(df, tokenizer_path, end_id), "ids")
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "width", "ids")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row per shard, with the ids in all shards before it as ``start``."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, wanted: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, or only of those wanted.

    ``start`` counts the ids of all documents before. Tasks read shards by seeking;
    with ``wanted`` (a short list of ids) no other document is decompressed.
    """
    only = None if wanted is None else frozenset(wanted)
    shards = manifest(spark, folder)
    names = ["doc_id", "start", "n_tokens", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            with system.open_input_file(f"{path}/shards/{row['shard']:06d}.zst") as source:
                shard = Shard(source, row["width"])
                starts = row["start"] + np.concatenate([[0], np.cumsum(shard.n_tokens)])
                ks = [k for k in range(shard.n_docs) if only is None or shard.doc_ids[k] in only]
                for at in range(0, len(ks), 512):
                    part = ks[at : at + 512]
                    columns = [[shard.doc_ids[k] for k in part], starts[part], shard.n_tokens[part], [shard.ids(k) for k in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
