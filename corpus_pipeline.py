"""A training-data pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns what is left of the documents, with
their columns (the last returns token ids). Stages are written as Parquet and read
again, so each is planned and recovered on its own.

Defined results, on top of the operators' own: a null text fails the quality rules; nulls
in other columns pass through (a null source is a source of its own in the mix); rows that
are the same in id and text become one in near-duplicate detection; other columns than
those of ``documents`` are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, lines, minhash, mixing, quality
from folio.llm.common import WS, documents, stored, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade keeps."""
    return quality.with_quality(docs.select(COLUMNS), order=quality.cascade_order(docs)).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines of recurring templates; ``n_chars`` follows.

    Near copies share a vote, since the next stage is to find them whole. A document of
    which no word is left goes.
    """
    changed = F.size("dropped") > 0
    rest = lines.dedup_lines(docs.select(COLUMNS), one_vote_per_family=True)
    left = rest.where(~changed | F.col("text").rlike(f"[^{WS}]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows that are the same in id and text count as one document, also without words.
    """
    keyed = docs.select(COLUMNS).withColumn("__h", F.xxhash64(text_or_empty()))
    found = minhash.near_duplicates(keyed, percent=80, carry=("__h",)).where("kept")
    firsts = found.where("cluster is not null").groupBy("cluster").agg(F.min(F.struct("doc_id", "__h")).alias("k")).select("k.*")
    keep = firsts.unionByName(found.where("cluster is null").select("doc_id", "__h"))
    name = F.coalesce("doc_id", F.lit(-(2**63))).alias("__id")
    kept = keyed.select("*", name).join(keep.select(name, "__h"), ["__id", "__h"], "left_semi")
    return kept.dropDuplicates(["__id", "__h"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs.select(COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text again."""
    tokens = bpe.with_tokens(docs.select(COLUMNS), BYTE_RANKS, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(text_or_empty(), "UTF-8")
    return tokens.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("byte bpe", byte_bpe),
]

#: SQL can't express byte-level BPE; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
