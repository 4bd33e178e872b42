"""What filters remove of each other's work, for every order of them.

Filters give each document a mask, a bit per filter that it fails; everything that is
reported of an order follows from how many documents of a part have which mask.

The filter for copies needs all texts of the table: an RDD is routed by the xxhash of the
text. Before that a task settles what it can by itself: of equal texts that it has seen only
the smallest id goes on, the others are copies already, so a text that a third of all rows
hold reaches its partition once a task (once a ``FLUSH_BYTES`` of texts). A partition is sorted by (hash, id), on disk
where it must be; the chain of the current hash holds each of its full texts with the
smallest id, and all larger ids are emitted as copies. Texts with the same hash are
told apart by their bytes. Masks (not texts) then meet the labels, and combineByKey merges
vectors of mask counts, of which there is one a part and task.

Defined results: a null text counts as empty (it fails the filter for short texts); a null
part is the empty string; a null ``doc_id`` neither is a copy nor makes one and has
no label; rows that are the same in id and text are counted each and do not make
each other copies; of several labels of an id the largest count; an empty table gives no
rows; columns other than ``doc_id``, ``text`` and ``part`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import stored

#: Bytes of distinct texts that a task holds to find copies by itself.
FLUSH_BYTES = 1 << 26
SIGNS = re.compile(rb"[#$%&*|]")
NO_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
#: Letters of the filters, in the order of their bits; the one for copies is the last.
FILTERS = "ABCDE"
COPY = 1 << 4
#: Columns of a vector: documents, of good quality, toxic.
COUNTED = 3
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(raw: bytes, n_chars: int) -> int:
    """The filters that a text fails by itself: few words, repeated words, capitals, signs."""
    words = raw.split()  # of bytes: the ASCII spaces only
    short = len(words) < 100
    dull = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * len(raw.translate(None, NO_CAPITALS)) > 10 * n_chars
    return short | dull << 1 | loud << 2 | bool(SIGNS.search(raw)) << 3


def settled(rows: Iterator, flush_bytes: int) -> Iterator[tuple[tuple[int, int], tuple]]:
    """((hash, id), (text or None, part, mask, rows)): the smallest ids of a task's texts, and its copies without a text."""
    import xxhash

    chains: dict[int, dict[bytes, list]] = {}
    held = 0

    def flush() -> Iterator[tuple]:
        for key, chain in chains.items():
            for raw, (doc_id, counts) in chain.items():
                for (part, mask), n in counts.items():
                    yield (key, doc_id), (raw, part, mask, n)
        chains.clear()

    for doc_id, text, part in rows:
        text, part = text or "", part or ""
        raw = text.encode()
        mask = own_mask(raw, len(text))
        if doc_id is None:
            yield (xxhash.xxh64_intdigest(part.encode()), 0), (None, part, mask, 1)
            continue
        chain = chains.setdefault(xxhash.xxh64_intdigest(raw), {})
        first = chain.get(raw)
        if first is None:
            chain[raw] = [doc_id, {(part, mask): 1}]
            held += len(raw)
        elif first[0] == doc_id:
            first[1][part, mask] = first[1].get((part, mask), 0) + 1
        else:
            later, lost = (doc_id, {(part, mask): 1}) if first[0] < doc_id else tuple(first)
            if later != doc_id:
                chain[raw] = [doc_id, {(part, mask): 1}]
            for (p, m), n in lost.items():
                yield (xxhash.xxh64_intdigest(str(later).encode()), later), (None, p, m | COPY, n)
        if held >= flush_bytes:
            yield from flush()
            held = 0
    yield from flush()


def chained(rows: Iterator) -> Iterator[tuple]:
    """(doc_id, part, mask, rows) of a partition in the order of (hash, id): all but the smallest id of a text are copies."""
    now, chain = None, {}
    for (key, doc_id), (raw, part, mask, n) in rows:
        if raw is None:
            yield (doc_id if mask & COPY else None), part, mask, n
            continue
        if key != now:
            now, chain = key, {}
        yield doc_id, part, mask | (COPY if chain.setdefault(raw, doc_id) < doc_id else 0), n


def masks(docs: DataFrame, part_col: str = "lang", flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """``doc_id, part, mask, n``: the filters that the rows of a document fail, and how many rows those are."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.col(part_col).alias("part")).rdd.map(tuple)
    routed = texts.mapPartitions(lambda rows: settled(rows, flush_bytes)).repartitionAndSortWithinPartitions(n, lambda key: key[0] % n)
    return stored(spark.createDataFrame(routed.mapPartitions(chained), "doc_id long, part string, mask int, n long", verifySchema=False), "masks")


def audited(counted: RDD, n_parts: int) -> RDD:
    """Vectors of ``(part, (mask, rows, good, toxic))``, a table of 32 masks each, merged by part."""

    def added(v: np.ndarray, x: tuple) -> np.ndarray:
        v[x[0]] += x[1:]
        return v

    return counted.combineByKey(lambda x: added(np.zeros((1 << len(FILTERS), COUNTED), np.int64), x), added, lambda a, b: a + b, n_parts)


def orders(part: str, v: np.ndarray) -> list[tuple]:
    """The 120 orders by 5 steps of one part, from its table of masks."""
    every = np.arange(len(v))
    fails = [(every >> k & 1).astype(bool) for k in range(len(FILTERS))]
    alone = [int(v[1 << k, 0]) for k in range(len(FILTERS))]
    made, shapley = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        alive = np.ones(len(v), bool)
        for step, k in enumerate(order, 1):
            lost, again = v[alive & fails[k]].sum(0), v[~alive & fails[k], 0].sum()
            alive &= ~fails[k]
            shapley[k] += int(lost[0])
            made.append((k, "".join(FILTERS[x] for x in order), step, v[alive, 0].sum(), lost[0], again, alone[k], lost[1], lost[2]))
    return [(part, name, step, *map(int, figures), shapley[k]) for k, name, step, *figures in made]


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """A row per part, order of the filters and step."""
    spark = docs.sparkSession
    n_parts = docs.agg(F.approx_count_distinct(F.coalesce(part_col, F.lit("")))).first()[0]
    yes: Callable[[str], F.Column] = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(yes("quality"), yes("toxic"))
    found = masks(docs, part_col, flush_bytes).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(known, "doc_id", "left")
    rows = found.select("part", "mask", "n", *(F.when(F.col(c) == 1, F.col("n")).otherwise(0).alias(c) for c in ("quality", "toxic")))
    summed = audited(rows.rdd.map(lambda r: (r[0], tuple(r[1:]))), max(1, min(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark.createDataFrame(summed.flatMap(lambda x: orders(*x)), OUT, verifySchema=False)
