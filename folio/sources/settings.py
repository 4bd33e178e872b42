"""Settings in ``key = value`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import leading_number

TRUE = ("true", "1", "yes", "on")
#: Settings that are lengths, and what they may be.
LENGTHS, SHORTEST, LONGEST = ("width", "height"), 200, 10_000


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``key, value, is_true, n`` of each line; ``#`` starts a comment, the last of equal keys counts.

    A width or height outside of its range is passed over; ``n`` is its number.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    pair = F.split(bare, r"\s*=\s*", 2)
    rows = lines.where(bare.contains("=")).select("at", F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value")).where("key != ''").withColumn("n", F.when(F.col("key").isin(*LENGTHS), leading_number(F.col("value"), whole=True)))
    rows = rows.where(F.col("n").isNull() | F.col("n").between(SHORTEST, LONGEST))
    last = rows.groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max_by("n", "at").alias("n"))
    return last.select("key", "value", F.lower("value").isin(*TRUE).alias("is_true"), "n")
