"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import align, audit, bpe, chat, lines, minhash, mixing, ngrams, pivots, quality, secrets, tokenfile, toxicity
from folio.llm.common import documents, new_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base_sha256 = F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base_sha256, secrets.listed(F.col("all")).alias("spans"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.with_tokens(documents(spark, sf_dir).select("doc_id", "text"), BYTE_RANKS, public_tokenizers.PATTERN)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    stale = chat.with_stale_reply(convs)
    pairs = chat.pairs_by_opening(convs).unionByName(stale.select((F.lit(-1) - F.col("conv_id")).alias("chosen_id"), F.col("conv_id").alias("rejected_id")))
    made = chat.format_preferences(convs.unionByName(stale), pairs)
    spans = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(m)
    return made.select("chosen_id", "rejected_id", "n_shared", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"), "differs")


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_copies(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    tokenfile.write_tokens(documents(spark, sf_dir), folder, WORD_TOKENIZER)
    return tokenfile.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pivots.top_k(vectors, F.col("id") % 100 == 0)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.with_quality(docs.select("doc_id", "text"), order=quality.cascade_order(docs)).drop("text")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85).drop("cluster")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(toxicity.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans")
    return toxicity.with_toxicity(docs, model).select("doc_id", held_out, "score", "predicted", spans)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(documents(spark, sf_dir), BYTE_TOKENIZER, PIECE_TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_byte_bpe, op3_preferences, op4_katz_backoff, op5_mix_sources, op6_token_files, op7_top_k, op8_line_templates, op9_quality_rules, op10_minhash, op11_toxicity, op12_filter_audit, op13_cross_tokenizer)
}
