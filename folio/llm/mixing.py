"""Mixing sources to target weights by Pareto order sampling.

Sources get shares of all words by weight, but none more than ``max_copies`` times its
own size; what a full source can't take is shared again by weight. With r = target /
size, every document of a source is taken floor(r) times for certain. The rest of the
target is drawn without replacement, with inclusion probabilities l = min(1, m h): h is a document's
importance and m one number per source, such that l times sizes sum up to that rest. Documents with l = 1
are taken for certain. Documents are ranked by random odds divided by
inclusion odds, ``(u / (1 - u)) / (l / (1 - l))``, and the ranking is cut where the drawn words come
nearest to the rest. The random number is a hash of the document's id and size, so reruns
agree. ``inclusion`` tells the probability that a document is drawn once more.

m comes from one histogram of importances per source, ``STEPS`` steps a doubling: where it makes a step
certain or not, the expected words are known exactly; inside the step between two such m they are
taken as linear, which misses the rest by less than a hundredth of that step's words.

The cut is found without sorting a source: ranks fall into 4,096 intervals, whose words
are summed (partial aggregation, also of a source with a third of all rows), and only the
interval that holds the cut is looked at row by row.

Defined results: a null text has size 0; rows with a null source form the last source;
sources of size 0 have target 0; rows that tie in rank, id and size (repeated rows) are
taken or left together; a null ``doc_id`` ranks before others in ties; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WS, stored

WEIGHTS = (5, 2, 1)
INTERVALS = 4096
#: The table of sources is broadcast up to so many rows; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Steps of the histogram of importances for a doubling of the importance.
STEPS = 64
#: Decimals of the multiplier's binary logarithm; sums of floating-point numbers may differ behind them.
DECIMALS = 9
LEAST_LONG = -(2**63)


def n_words(text: Column) -> Column:
    """Words of a text, counted by shrinking each, with the space after it, to one letter."""
    one_each = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{WS}]*+[^{WS}]++[{WS}]*+", "x")
    return F.length(F.regexp_replace(one_each, rf"[{WS}]++", "")).cast("long")


def with_random(df: DataFrame, id_col: str, text_col: str, source_col: str, importance: Column, seed: int) -> DataFrame:
    """The rows with ``__id, __source, __size, __u, __h``: u is uniform between 0 and 1, h the importance."""
    sized = df.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_LONG)), "__source": F.col(source_col).cast("string"), "__size": n_words(F.col(text_col).cast("string"))})
    name = F.concat_ws(":", F.col("__id").cast("string"), F.col("__size").cast("string"), F.lit(str(seed)))
    drawn = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    return sized.withColumns({"__u": (drawn + F.lit(0.5)) / F.lit(float(2**52)), "__h": importance.cast("double")})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """``source_size`` and ``target`` per source, from a table of one row per source.

    Sources are filled in the order in which they would reach their limit. The first
    that stays below it tells the words per weight for all that follow.
    """
    everything = Window.partitionBy()
    in_order = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = in_order.withColumn("weight", weight).withColumn("limit", F.lit(max_copies) * F.col("source_size"))
    full_first = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = limited.withColumns({"level": left / weights_left, "turn": F.row_number().over(full_first)})
    first = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct("turn", "level"))).over(everything)
    final = levels.withColumn("per_weight", F.coalesce(first["level"], F.lit(0.0)))
    return final.select("__source", "source_size", F.least(F.col("limit").cast("double"), F.col("per_weight") * F.col("weight")).alias("target"))


def _with_source(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    side = plan.withColumnRenamed("__source", "__of")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    return rows.join(side, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")


def _inclusion() -> Column:
    return F.when(F.col("rest") > 0, F.least(F.lit(1.0), F.col("multiplier") * F.greatest(F.col("__h"), F.lit(0.0)))).otherwise(F.lit(0.0))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``__rank`` from 0 to 1, which grows with the ratio of the odds; certain documents have rank 0."""
    chance = _inclusion()
    ratio = (F.col("__u") / (1 - F.col("__u"))) / (chance / (1 - chance))
    rank = F.when(chance >= 1, F.lit(0.0)).when(chance > 0, ratio / (1 + ratio))
    return rows.withColumn("__rank", F.coalesce(rank, F.lit(1.0)))


def calibrated(small: DataFrame, goals: DataFrame) -> DataFrame:
    """The goals with ``multiplier``: the factor of the importance with which the expected words are the rest."""
    step = F.floor(F.log2("__h") * STEPS).alias("step")
    sums = small.where("__h > 0 and __size > 0").groupBy("__source", step).agg(F.sum("__size").alias("words"), F.sum(F.col("__size") * F.col("__h")).alias("weighed"))
    sums = sums.join(goals.select(F.col("__source").alias("__of"), "rest"), F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    higher, upto = Window.partitionBy("__source").orderBy(F.desc("step")), Window.partitionBy("__source").orderBy("step")
    certain = F.coalesce(F.sum("words").over(higher.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sums.withColumns({"certain": certain, "upto": F.sum("weighed").over(upto), "low": F.pow(F.lit(2.0), -(F.col("step") + 1) / STEPS), "high": F.pow(F.lit(2.0), -F.col("step") / STEPS)})
    # expected words where the step is about to become certain, and where it is
    told = told.withColumns({"at_low": F.col("certain") + F.col("low") * F.col("upto"), "at_high": F.col("certain") + F.col("words") + F.col("high") * (F.col("upto") - F.col("weighed"))})
    inside = F.col("low") + (F.col("high") - F.col("low")) * (F.col("rest") - F.col("at_low")) / (F.col("at_high") - F.col("at_low"))
    sought = F.when(F.col("at_low") >= F.col("rest"), (F.col("rest") - F.col("certain")) / F.col("upto")).otherwise(inside)
    first = told.where("rest > 0 and at_high >= rest").groupBy(F.col("__source").alias("__of")).agg(F.max_by(sought, "step").alias("sought"))
    multiplier = F.pow(F.lit(2.0), F.round(F.log2("sought"), DECIMALS))
    return goals.join(first, F.col("__source").eqNullSafe(F.col("__of")), "left").withColumn("multiplier", F.coalesce(multiplier, F.lit(2.0**1000))).drop("__of", "sought")


def _key() -> Column:
    return F.struct(F.col("__rank").alias("r"), F.col("__id").alias("i"), F.col("__size").alias("s"))


def _edge(rank: Column) -> Column:
    return F.struct(rank.alias("r"), F.lit(LEAST_LONG).alias("i"), F.lit(-1).cast("long").alias("s"))


def sampling_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3) -> tuple[DataFrame, int]:
    """Per source: size, target, whole copies and the last rank that is drawn; and how many sources there are."""
    small = stored(rows.select("__id", "__source", "__size", "__u", "__h"), "sizes")
    goals = targets(small.groupBy("__source").agg(F.sum("__size").alias("source_size")), weights, max_copies)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = stored(goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    n_sources = goals.count()
    goals = stored(calibrated(small, goals), "multipliers")
    ranked = _ranked(_with_source(small, goals, n_sources)).withColumn("interval", F.floor(F.col("__rank") * INTERVALS))
    sums = ranked.groupBy("__source", "interval").agg(F.sum("__size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("__source").orderBy("interval")
    crossing = sums.withColumn("upto", F.sum("words").over(upto)).where("upto > rest")
    cut = crossing.groupBy("__source").agg(F.min(F.struct("interval", (F.col("upto") - F.col("words")).alias("before"))).alias("c")).select(F.col("__source").alias("__of"), "c.*")
    cut = stored(cut, "cuts").withColumnRenamed("interval", "at")
    side = F.broadcast(cut) if n_sources <= BROADCAST_SOURCES else cut
    there = ranked.join(side, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("interval") == F.col("at")))
    taken = F.col("before") + F.sum("__size").over(Window.partitionBy("__source").orderBy("__rank", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0))
    nearer = (F.col("taken") <= F.col("rest")) | (F.col("taken") - F.col("rest") < F.col("rest") - (F.col("taken") - F.col("__size")))
    last = there.withColumn("taken", taken).where(nearer).groupBy("__source").agg(F.max(_key()).alias("last")).withColumnRenamed("__source", "__with")
    plan = goals.join(cut.select("__of", "at"), F.col("__source").eqNullSafe(F.col("__of")), "left").join(last, F.col("__source").eqNullSafe(F.col("__with")), "left")
    drawn = F.when(F.col("rest") <= 0, _edge(F.lit(-1.0))).when(F.col("at").isNull(), _edge(F.lit(2.0))).otherwise(F.coalesce("last", _edge(F.col("at") / F.lit(float(INTERVALS)))))
    return stored(plan.select("__source", "source_size", "target", "whole", "rest", "multiplier", drawn.alias("last")), "plan"), n_sources


def with_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3, seed: int = 1) -> DataFrame:
    """Add ``size, source_size, target, copies, inclusion`` to the rows.

    ``importance`` multiplies a document's inclusion probability and may use ``__size``; by
    default it is the root of the size.
    """
    importance = F.sqrt(F.greatest(F.col("__size"), F.lit(1))) if importance is None else importance
    made = ("size", "source_size", "target", "copies", "inclusion", "whole", "rest", "multiplier", "last")
    rows = with_random(df.drop(*(c for c in made if c in df.columns)), id_col, text_col, source_col, importance, seed)
    plan, n_sources = sampling_plan(rows, weights, max_copies)
    ranked = _ranked(_with_source(rows, plan, n_sources))
    copies = (F.col("whole") + F.when(_key() <= F.col("last"), 1).otherwise(0)).cast("long")
    return ranked.withColumns({"size": F.col("__size"), "copies": copies, "inclusion": _inclusion()}).drop("__id", "__source", "__size", "__u", "__h", "__rank", "whole", "rest", "multiplier", "last")


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns."""
    return with_copies(df, **options).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*df.columns)
