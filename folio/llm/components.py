"""Connected components of a link table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import stored


def connect(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b`` links; a label names its component.

    In a round each node moves to its smallest neighbour (or stays, if it is smaller)
    and links follow. Nodes are hashes, so their order is random and a constant share
    of them goes in each round: the rounds grow with the logarithm of a component's
    size. Each round is a partial aggregation and joins; nothing goes to the driver
    but the question whether links are left.
    """
    links = stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        moves = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "from"), "moves")
        labels = stored(labels.join(moves, labels["label"] == moves["from"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left, right = moves.select(F.col("from").alias("a"), F.col("to").alias("a2")), moves.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        moved = links.join(left, "a").join(right, "b").where("a2 != b2")
        links = stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    return labels
