"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes). Texts
   with equal sets form a *class*; all that follows works on classes, so thousands
   of copies or repeated rows cost no more than one text.
2. A class has a signature of 128 minimum hashes, and bands of some of them put it into
   buckets. Number and width of the bands follow from the threshold: a pair at it shares
   no bucket with probability ``MISS`` at most.
3. In each bucket the class that shares the most buckets with others is the hub, and
   candidates are (hub, member): linear in the bucket's size. Members that turn out
   linked need no further comparison with each other, as they share a component. Buckets
   that still hold several components get another hub, ``HUB_ROUNDS`` times.
   What is left of them is compared in blocks of bounded size, by signatures. No other pair
   that could join two components is left out.
4. A candidate pair's signatures are compared batch by batch. With m of n equal and a
   uniform prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m); below the chosen
   miss probability the pair is dropped. Survivors alone meet their full sets: hubs' pairs in a
   join, those of blocks in blocks of bounded size.

Defined results: texts without words (or null) have no shingles and are linked with
nothing; fewer than five words are one shingle; copies, ties and repeated rows are
linked like any others; a null ``doc_id`` is passed over when the smallest id of a
component is sought; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import stored
from folio.llm.components import connect

WIDTH, HASHES, BATCH = 5, 128, 32
MISS = 1e-6
#: Members of a block of a bucket, and shingles of a block of its survivors, about.
BLOCK, CELL = 4096, 1 << 20
HUB_ROUNDS = 3


class Shingler:
    """Distinct shingle hashes of texts; word hashes are remembered for a while."""

    def __init__(self, width: int = WIDTH):
        import xxhash

        self._hash, self._width, self._known = xxhash.xxh3_64_intdigest, width, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()  # of bytes: A-Z and the white space of ASCII only
        if not words:
            return np.empty(0, np.uint64)
        known = self._known
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self._width, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, np.multiply.outer(factors, shingles[at : at + 4096]).min(axis=1))
    return least


def odd_factors(n: int = HASHES, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def banding(percent: int, miss: float = MISS, hashes: int = HASHES) -> tuple[int, int]:
    """How many bands of how many hashes: the widest with which a pair at the threshold is missed with this probability at most."""
    fitting = [(ceil(log(miss) / log1p(-((percent / 100) ** rows))), rows) for rows in range(1, hashes + 1) if 1e-9 < (percent / 100) ** rows < 1]
    fitting = [(bands, rows) for bands, rows in fitting if bands * rows <= hashes]
    if not fitting:
        raise ValueError(f"{hashes} hashes are too few for a threshold of {percent} percent")
    return fitting[-1]


def sketches(df: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """All columns but the text, with ``n_shingles, cls, sig, bands``.

    ``cls`` names the set, null for an empty one; ``sig`` holds 16 bits of each
    minimum; ``bands`` are 64-bit bucket names.
    """
    kept = [f for f in df.schema.fields if f.name not in (text_col, "n_shingles", "cls", "sig", "bands")]
    names = [f.name for f in kept]
    types = {"n_shingles": T.LongType(), "cls": T.BinaryType(), "sig": T.BinaryType(), "bands": T.ArrayType(T.LongType())}
    arrow = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    n_bands, width = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles_of, factors = Shingler(), odd_factors()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[tuple] = []
                for raw in pc.fill_null(batch.column("__text"), "").cast(pa.binary()).to_pylist():
                    s = shingles_of(raw)
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    least = signature(s, factors)
                    bands = [xxhash.xxh3_64_intdigest(least[k * width : k * width + width].tobytes(), seed=k) - 2**63 for k in range(n_bands)]
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), (least >> np.uint64(16)).astype("<u2").tobytes(), bands))
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, *types])

    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, T.StructType([*kept, *(T.StructField(k, t) for k, t in types.items())]))


def shingle_sets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``cls, shingles`` of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles_of = Shingler()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                sets = [shingles_of(raw) for raw in pc.fill_null(whole.column(0).slice(at, 256), "").cast(pa.binary()).to_pylist()]
                sets = [s for s in sets if len(s)]
                values = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                names = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["cls", "shingles"])

    return df.select(text_col).mapInArrow(run, "cls binary, shingles array<long>")


def least_matches(percent: int, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest equal hashes at which a pair stays a candidate."""
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def bayes_survivors(x: np.ndarray, y: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Rows of two signature arrays that no batch rules out."""
    alive, same = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, m in enumerate(least):
        part = slice(k * batch, (k + 1) * batch)
        same[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
        alive = alive[same[alive] >= m]
    return alive


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be so similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` pairs that sequential verification of their signatures lets pass."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).take(pa.array(bayes_survivors(x, y, least)))

    left = nodes.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = nodes.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    both = pairs.join(left, "a").join(right, "b").where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def verified(survivors: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    enough = 100 * both >= percent * (F.size("s") + F.size("t") - both)
    return survivors.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _dealt(placed: DataFrame) -> DataFrame:
    """Members of ``n_blocks`` blocks of a bucket, dealt to the pairs (i, j) of blocks that hold them."""
    block = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    both = placed.withColumn("block", block).select("bucket", "cls", "label", "block", other)
    return both.select("bucket", "cls", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _partners(key: tuple, rows: pd.DataFrame, percent: int, least: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later ones that sequential verification lets pass: of another ``label``, in the first bucket that both share."""
    sig = np.frombuffer(b"".join(rows["sig"]), "<u2").reshape(-1, HASHES)
    bands, own, n = np.stack(rows["bands"]), rows["block"].to_numpy(), rows["n_shingles"].to_numpy()
    label = pd.factorize(rows["label"])[0]
    bucket, i, j = key
    for k in range(len(rows) - 1):
        # a pair within one block belongs to (i, i), one across to (i, j)
        fits = 100 * np.minimum(n[k + 1 :], n[k]) >= percent * np.maximum(n[k + 1 :], n[k])
        rest = k + 1 + np.flatnonzero(fits & (label[k + 1 :] != label[k]) & ((own[k + 1 :] != own[k]) | (i == j)))
        if len(rest):
            rest = rest[bayes_survivors(np.broadcast_to(sig[k], (len(rest), HASHES)), sig[rest], least)]
        if len(rest):
            rest = rest[bands[k][(bands[rest] == bands[k]).argmax(axis=1)] == bucket]
        if len(rest):
            yield k, rest[np.argsort(-(sig[rest] == sig[k]).sum(axis=1), kind="stable")]


def block_survivors(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``bucket, cls``: members of a bucket with a partner in another component that sequential verification lets pass.

    A bucket is compared in blocks of about ``BLOCK`` members; only signatures travel, and no pairs are given out.
    """
    least = least_matches(percent)
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    dealt = _dealt(members.select("bucket", "cls", "label").join(stored(sizes, "open-buckets"), "bucket"))
    whole = dealt.join(nodes.select("cls", "sig", "bands", "n_shingles"), "cls")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls")
        found = np.zeros(len(rows), bool)
        for k, rest in _partners(key, rows, percent, least):
            found[k] = True
            found[rest] = True
        return rows.loc[found, ["bucket", "cls"]]

    return whole.groupBy("bucket", "i", "j").applyInPandas(compare, "bucket long, cls binary").distinct()


def block_links(members: DataFrame, survivors: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between components that the survivors' full sets confirm.

    A bucket's survivors are compared once more, now with their sets, in blocks of about ``CELL`` shingles.
    A block verifies a member's likeliest partners first, and leaves out those whose components it has found linked already.
    """
    least = least_matches(percent)
    here = stored(members.select("bucket", "cls", "label").join(survivors, ["bucket", "cls"]).join(nodes.select("cls", "n_shingles"), "cls"), "surviving")
    sizes = here.groupBy("bucket").agg(F.ceil(F.sum("n_shingles") / CELL).cast("int").alias("n_blocks"))
    dealt = _dealt(here.drop("n_shingles").join(stored(sizes, "cells"), "bucket"))
    whole = dealt.join(nodes.select("cls", "sig", "bands", "n_shingles"), "cls").join(sets, "cls")

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls")
        cls, known, name = rows["cls"].to_numpy(), rows["shingles"].to_numpy(), pd.factorize(rows["label"])[0]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        out = []
        for k, rest in _partners(key, rows, percent, least):
            for x in rest:
                a, b = find(name[k]), find(name[x])
                if a != b and _similar(known[k], known[x], percent):
                    out.append((cls[k], cls[x]))
                    root[max(a, b)] = min(a, b)
        return pd.DataFrame(out, columns=["a", "b"])

    return whole.groupBy("bucket", "i", "j").applyInPandas(verify, "a binary, b binary").distinct()


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def near_duplicates(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, then ``cluster`` and the carried columns, for every row.

    ``cluster`` names the component (null for a text without words).
    """
    carried = [F.col(c) for c in carry]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), *carried)
    seen = stored(sketches(rows, percent), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")]
    classes = stored(seen.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.min("text_hash").alias("text_hash"), *firsts), "classes")
    placed = classes.select("cls", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(placed.join(sizes, "bucket"), "buckets")
    degree = stored(shared.groupBy("cls").agg(F.sum(F.col("size") - 1).alias("degree")), "degrees")
    nodes = stored(classes.join(degree, "cls").select("cls", "text_hash", "n_shingles", "sig", "bands"), "nodes")
    # one text of each class that shares a bucket; both sides grow with the corpus, so neither is for broadcast
    sets = stored(shingle_sets(rows.select("text", "text_hash").join(nodes.select("text_hash").hint("merge"), "text_hash", "left_semi")).dropDuplicates(["cls"]), "sets")

    members = shared.select("bucket", "cls").join(degree, "cls").withColumn("label", F.col("cls"))
    links, labels = None, None
    for _ in range(HUB_ROUNDS):
        hubs = stored(members.groupBy("bucket").agg(F.max(F.struct("degree", "cls", "label")).alias("hub")), "hubs")
        with_hub = stored(members.join(hubs, "bucket").select("bucket", "cls", "degree", "label", F.col("hub.cls").alias("hub"), F.col("hub.label").alias("hub_label")), "with-hubs")
        pairs = with_hub.where("label != hub_label").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
        new = verified(plausible(pairs, nodes, percent), sets, percent).distinct()
        links = stored(new if links is None else links.unionByName(new).distinct(), "links")
        labels = connect(links)
        members = stored(_open_buckets(with_hub.where("cls != hub").select("bucket", "cls", "degree"), labels), "members")
        if members.isEmpty():
            break
    else:
        labels = connect(links.unionByName(block_links(members, stored(block_survivors(members, nodes, percent), "survivors"), nodes, sets, percent)).distinct())
    of_class = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first_doc", F.coalesce("label", "cls").alias("cluster"))
    smallest = of_class.groupBy("cluster").agg(F.min("first_doc").alias("least_doc"))
    result = seen.drop("sig", "bands").join(of_class.select("cls", "cluster").join(smallest, "cluster"), "cls", "left")
    component: Column = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least_doc"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "cluster", *carried)


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    now = stored(members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    several = stored(now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket"), "several")
    return now.join(several, "bucket")
