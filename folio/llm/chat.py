"""Preference formatting of chat turns, in DataFrame operations.

A pair names a chosen and a rejected conversation. Their longest common prefix of turns
(equal role and text) is rendered once, as the prompt; what follows in each is rendered
as its completion. A completion has a mask: the stretches, in code points, of the
assistant's texts, on which a model is to be trained. The tags around them and other
roles' turns are outside of the mask.

Defined results: null roles and texts count as empty; turns are ordered by number (nulls
first), then role and text, and equal rows are turns of their own; rows without a
``conv_id`` are in no conversation; a pair whose conversation is missing gives no row;
identical conversations have an empty completion on either side and ``differs`` false;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: a row per conversation, with its turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select("conv_id", F.struct(F.col("turn"), role, text).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def pairs_by_opening(convs: DataFrame) -> DataFrame:
    """``chosen_id, rejected_id``: each conversation against the first one that opens with the same turn.

    The first of a group is the smallest id (a partial aggregation), so a group gives one
    pair fewer than it has conversations, however large it is.
    """
    keyed = convs.where(F.size("turns") > 0).select("conv_id", F.sha2(F.concat_ws("\x00", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256).alias("opening"))
    firsts = keyed.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"))
    return keyed.join(firsts, "opening").where("conv_id != chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))


def with_stale_reply(convs: DataFrame) -> DataFrame:
    """Conversations to reject: the last reply is the first one over again, or empty if it is the only one.

    Such a conversation has the id -1 - ``conv_id``; those without a reply give none.
    """
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, F.struct(i.alias("i"), t["text"].alias("text")))), lambda x: x.isNotNull())
    first, last = F.col("replies")[0], F.element_at("replies", -1)
    stale = F.when(F.size("replies") > 1, first["text"]).otherwise(F.lit(""))
    turns = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last["i"], stale).otherwise(t["text"]).alias("text")))
    return convs.withColumn("replies", replies).where(F.size("replies") > 0).select((F.lit(-1) - F.col("conv_id")).alias("conv_id"), turns.alias("turns"))


def tag(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(tag(t["role"]), t["text"], F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """``start, end`` of the trained texts in the rendered turns."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(tag(t["role"]))
        end = start + F.length(t["text"])
        more = F.when(t["role"] == TRAINED_ROLE, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], more).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda state: state["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are the same."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(a)).cast("int")


def format_preferences(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per pair: ``prompt``, both completions and both masks.

    A conversation that many pairs share meets them in a shuffle join, which splits
    its rows over tasks.
    """
    chosen = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    rejected = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    both = pairs.join(rejected, "rejected_id").join(chosen, "chosen_id").withColumn("n_shared", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n_shared") + 1, F.greatest(F.size(x) - F.col("n_shared"), F.lit(0)))
    return both.select(
        "chosen_id",
        "rejected_id",
        "n_shared",
        rendered(F.slice("c", 1, F.col("n_shared"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"),
        mask(rest("r")).alias("rejected_mask"),
        (~F.col("c").eqNullSafe(F.col("r"))).alias("differs"),
    )
