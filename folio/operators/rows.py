"""Small tools that the format readers share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of a batch that a reader hands on, about.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
#: Bytes that a value in a list counts as.
ITEM_BYTES = 32


def expand(df: DataFrame, make: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows made from each row by a Python reader, batch by batch through Arrow.

    A batch is handed on when it has many rows or many bytes, so a worker holds little more
    than what the reader makes of one row.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    long = [k for k, f in enumerate(arrow) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]
    lists = [k for k, f in enumerate(arrow) if pa.types.is_list(f.type)]

    def packed(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(batch.num_rows):
                for row in make(batch.slice(at, 1).to_pylist()[0]):
                    made.append(row)
                    for k in long:
                        if row[k]:
                            size += len(row[k])
                    for k in lists:
                        if row[k]:
                            size += ITEM_BYTES * len(row[k])
                    if len(made) >= BATCH_ROWS or size >= BATCH_BYTES:
                        full, made, size = packed(made), [], 0
                        yield full
                        del full
                    del row
            del batch  # before the next one comes
            pa.default_memory_pool().release_unused()
        if made:
            yield packed(made)

    return df.mapInArrow(run, schema)


def joined(value: Column | str, order: Column | str, separator: str = "") -> Column:
    """Aggregate: the values in order, as one string."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def capped(df: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The first rows of each group as ``n`` = 1, 2, ..., and whether it has more.

    The limit on row numbers works before the shuffle; totals are partial counts.
    """
    first = df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("n") <= limit)
    totals = df.groupBy(F.col(key).alias("__key")).agg((F.count("*") > limit).alias("truncated"))
    return first.join(totals, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def first_match(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A lookup table: of rows with equal keys, the value of the first."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))
