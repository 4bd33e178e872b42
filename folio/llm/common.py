"""What several operators share: reading inputs and keeping intermediate tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.work import new_path, shared_dir, spread, stored

__all__ = ["WORD", "WS", "documents", "new_path", "per_worker", "shared_dir", "stored", "text_or_empty"]

#: The white space of the contracts: space and U+0009 to U+000D.
WS = r"\x20\x09-\x0D"
#: A word: a maximal run without white space.
WORD = rf"[^{WS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def per_worker(slot: str, key: str, make: Callable[[], object]):
    """An object that a Python worker makes once and keeps for its later tasks, until the slot gets another key."""
    kept = sys.modules.setdefault("_folio_worker", types.ModuleType("_folio_worker")).__dict__
    if slot not in kept or kept[slot][0] != key:
        kept[slot] = (key, make())
    return kept[slot][1]
