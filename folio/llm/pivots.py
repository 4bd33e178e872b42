"""Exact top-k inner products by pivot-table elimination.

Vectors become integers. A table holds each vector's distances to many pivots. For a
query q and a candidate x the triangle inequality gives, over all pivots p,
``|q - x| >= max |d(q, p) - d(x, p)|``, and with it the upper bound
``q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + |x|^2 - bound^2) / 2``.
Candidates are evaluated in the order of that bound until the k-th best score exceeds
all bounds that are left; no candidate that could enter the result is skipped, ties
included.

Vectors lie in blocks of bounded size by their nearest two pivots, and a block has for each
pivot the range of its distances. A query is first answered in its own block, which gives it a k-th
score to beat. The ranges bound what any other block could hold, so a query goes only to
blocks that may beat that score, and carries it along. A block is copied once per
``QUERY_BLOCK`` queries that need it. The k best of all blocks are merged.

Defined results: vectors that are null or hold a null or non-finite component take no
part; so do rows without an id. Vectors of unequal length count as padded with zeros.
Rows that repeat an id are candidates of their own; a query passes over all rows of its
own id. Scores beyond a 64-bit integer are held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import stored

#: Pivots, and vectors that they are chosen from: a bounded, evenly hashed draw.
PIVOTS, PIVOT_DRAW = 32, 1024
#: Vectors of a block of candidates, of a block of queries; and blocks whose ranges are looked at together.
BLOCK, QUERY_BLOCK, PACK = 8192, 2048, 4096
#: Up to here sums of products are exact in double precision.
EXACT = float(2**53)
LONG = 2**63 - 1


def taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def whole_numbers(v: np.ndarray, scale: int) -> np.ndarray:
    top = np.finfo(np.float64).max / scale
    return np.floor(np.clip(v, -top, top) * scale)


def padded(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Row by pivot; short rows and pivots are padded to each other's length."""
    dim = max(x.shape[1], pivots.shape[1])
    x, pivots = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (x, pivots))
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def choose_pivots(rows: DataFrame, scale: int, n: int = PIVOTS, draw: int = PIVOT_DRAW) -> np.ndarray:
    """Farthest-first choice among the ``draw`` vectors whose ids hash lowest."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(draw).collect()
    if not drawn:
        return np.zeros((0, 0))
    x = padded([whole_numbers(np.array(r.v, np.float64), scale) for r in drawn], max(len(r.v) for r in drawn))
    chosen, gap = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def pivot_table(rows: DataFrame, pivots: np.ndarray, scale: int) -> DataFrame:
    """``id, x, far, cell``: the whole numbers and the distances to the pivots, as double arrays in bytes, and the two nearest pivots as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), [whole_numbers(np.array(v, np.float64), scale) for v in batch.column(1).to_pylist()]
            if vectors:
                x = padded(vectors, max(map(len, vectors)))
                far = distances(x, pivots)
                nearest = np.argsort(far, axis=1, kind="stable")
                cell = nearest[:, 0] * PIVOTS + nearest[:, min(1, far.shape[1] - 1)] if far.shape[1] else np.zeros(len(x), np.int64)
                blobs = [[row.tobytes() for row in m] for m in (vectors, far)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(b, pa.binary()) for b in blobs), pa.array(cell, pa.int32())], names=["id", "x", "far", "cell"])

    return rows.mapInArrow(run, "id long, x binary, far binary, cell int")


def in_blocks(table: DataFrame) -> DataFrame:
    """Adds ``block``. There are ``PIVOTS`` squared cells at most: neighbours share a block up to its size, large ones are split."""
    sizes = {r.cell: r["count"] for r in table.groupBy("cell").count().collect()}
    first, parts = [0] * PIVOTS**2, [1] * PIVOTS**2
    block, room, pivot = -1, 0, None
    for cell in sorted(sizes):
        parts[cell] = max(1, -(-sizes[cell] // BLOCK))
        if sizes[cell] > room or pivot != cell // PIVOTS:
            block, room, pivot = block + 1, BLOCK, cell // PIVOTS
        first[cell] = block
        room -= sizes[cell]
        block += parts[cell] - 1
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    return table.withColumn("block", (of(first) + F.pmod(F.xxhash64("at"), of(parts))).cast("int")).drop("cell")


def ranges(table: DataFrame) -> DataFrame:
    """``block, lo, hi, longest``: per block the ranges of the distances to each pivot, and the largest squared length."""
    schema = "block int, lo binary, hi binary, longest double"

    def summed(rows: pd.DataFrame, lo: list, hi: list, longest: list) -> pd.DataFrame:
        data = pd.DataFrame({"block": rows["block"], "k": range(len(rows))})
        out = []
        for block, own in data.groupby("block")["k"]:
            out.append((block, np.min([lo[k] for k in own], axis=0).tobytes(), np.max([hi[k] for k in own], axis=0).tobytes(), max(longest[k] for k in own)))
        return pd.DataFrame(out, columns=["block", "lo", "hi", "longest"]).astype({"block": "int32"})

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            far = [np.frombuffer(b) for b in rows["far"]]
            with np.errstate(over="ignore"):
                longest = [float((np.frombuffer(b) ** 2).sum()) for b in rows["x"]]
            yield pa.RecordBatch.from_pandas(summed(rows, far, far, longest), preserve_index=False)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return summed(rows, [np.frombuffer(b) for b in rows["lo"]], [np.frombuffer(b) for b in rows["hi"]], rows["longest"].tolist())

    return table.select("block", "x", "far").mapInArrow(partly, schema).groupBy("block").applyInPandas(whole, schema)


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ q).astype(np.int64)
    whole = [int(a) for a in q]
    return np.array([max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], np.int64)


def upper_bound(qq, xx, apart):
    """Of inner products, from squared lengths and a lower bound of the distance; the slack covers the rounding of the distances."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((qq + xx - apart**2) / 2 + 1e-9 * (qq + xx) + 1, nan=np.inf)


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, step: int = 256) -> pd.DataFrame:
    """The k best of one block of candidates for each query of one block, as far as they reach the query's ``least`` score.

    The candidates with the highest bounds are evaluated first; each round leaves out those whose bounds lie below
    the k-th score so far, and the search ends when none is left.
    """
    qs, xs = ([np.frombuffer(b) for b in d["x"]] for d in (queries, candidates))
    dim = max(max(map(len, qs)), max(map(len, xs)))
    q, x = padded(qs, dim), padded(xs, dim)
    far_q, far_x = (np.stack([np.frombuffer(b) for b in d["far"]], axis=1) for d in (queries, candidates))
    with np.errstate(over="ignore", invalid="ignore"):
        qq, xx = (q**2).sum(axis=1), (x**2).sum(axis=1)
        exact = float(np.sqrt(qq.max() * xx.max())) < EXACT
    ids = candidates["id"].to_numpy()
    out: list[np.ndarray] = []
    for i, (query, row, least) in enumerate(zip(queries["id"], queries["row"], queries["least"], strict=True)):
        with np.errstate(over="ignore", invalid="ignore"):
            apart = np.abs(far_x - far_q[:, i : i + 1]).max(axis=0, initial=0)
        bound = upper_bound(qq[i], xx, apart)
        left = np.flatnonzero((bound >= least) & (ids != query))
        best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = step
        while len(left):
            bounds = bound[left]
            first = np.argpartition(-bounds, n)[:n] if len(left) > n else np.arange(len(left))
            part = left[first]
            score, name = np.append(best_score, products(x[part], q[i], exact)), np.append(best_id, ids[part])
            order = np.lexsort((name, ~score))[:k]  # ~ falls as scores rise, and never overflows
            best_score, best_id = score[order], name[order]
            bounds[first] = -np.inf
            # a bound that equals the k-th score may still hold a tie
            left = left[bounds >= (best_score[-1] if len(best_score) == k else np.finfo(np.float64).min)]
            n *= 2
        out.append(np.stack([np.full(len(best_id), query), np.full(len(best_id), row), best_id, best_score], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=FOUND).astype("int64")


FOUND = ["query_id", "row", "vec_id", "score"]
NOTHING = pd.DataFrame({c: pd.Series(dtype="int64") for c in FOUND})


def needed_blocks(queries: DataFrame, blocks: DataFrame, n_packs: int, n_query_blocks: int) -> DataFrame:
    """``query_id, row, block`` where a block other than the query's own may beat its ``least`` score."""

    def run(asking: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(known):
            return pd.DataFrame({"query_id": [], "row": [], "block": []}).astype("int64")
        lo, hi = (np.stack([np.frombuffer(b) for b in known[c]]) for c in ("lo", "hi"))
        longest, name = known["longest"].to_numpy(), known["block"].to_numpy()
        out = []
        for r in asking.itertuples():
            far = np.frombuffer(r.far)
            with np.errstate(over="ignore", invalid="ignore"):
                qq = float((np.frombuffer(r.x) ** 2).sum())
                apart = np.maximum(np.maximum(lo - far, far - hi), 0).max(axis=1, initial=0)
            may = name[(upper_bound(qq, longest, apart) >= r.least) & (name != r.block)]
            out.append(pd.DataFrame({"query_id": r.id, "row": r.row, "block": may}))
        return pd.concat(out)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "row", "x", "far", "least", "block", "q_block", every(n_packs).alias("pack"))
    right = blocks.withColumn("pack", F.pmod("block", F.lit(n_packs))).withColumn("q_block", every(n_query_blocks))
    return left.groupBy("q_block", "pack").cogroup(right.groupBy("q_block", "pack")).applyInPandas(run, "query_id long, row long, block int")


def top_k(candidates: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query.

    ``is_query`` is a condition on ``id`` that states the queries. Query rows that
    are the same in id and vector are answered once.
    """
    rows = taking_part(candidates, id_col, vector_col)
    cells = stored(pivot_table(rows, choose_pivots(rows, scale), scale).withColumn("at", F.monotonically_increasing_id()), "cells")
    table = stored(in_blocks(cells), "pivot-table")
    blocks = stored(ranges(table), "ranges")
    schema = "query_id long, row long, vec_id long, score long"
    queries = stored(table.where(is_query).dropDuplicates(["id", "x"]).withColumn("row", F.xxhash64("x")), "queries")
    lowest = F.lit(float("-inf"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, k) if len(a) and len(b) else NOTHING

    own = stored(queries.withColumn("least", lowest).groupBy("block").cogroup(table.groupBy("block")).applyInPandas(search, schema), "own-block")
    n_query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    n_packs = max(1, -(-blocks.count() // PACK))
    worst = own.groupBy("query_id", "row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(lowest).alias("least"))
    told = queries.join(worst, (queries["id"] == worst["query_id"]) & (queries["row"] == worst["row"]), "left").select(queries["id"], queries["row"], "x", "far", "block", F.coalesce("least", lowest).alias("least"))
    asking = stored(told.withColumn("q_block", F.pmod(F.xxhash64("id", "row"), F.lit(n_query_blocks)).cast("int")), "asking")
    needed = stored(needed_blocks(asking, blocks, n_packs, n_query_blocks), "needed")
    sent = needed.join(asking.withColumnRenamed("id", "query_id").drop("block"), ["query_id", "row"]).withColumnRenamed("query_id", "id")
    there = stored(sent.select("block", "q_block").distinct(), "pairs-of-blocks")
    found = sent.groupBy("block", "q_block").cogroup(table.join(there, "block").groupBy("block", "q_block")).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return own.unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
