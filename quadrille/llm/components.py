"""Connected components of a table of links, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of the links: the smallest node that it reaches.

    Each round a node takes the smallest label around it, then its label's label; the rounds needed grow
    with the logarithm of the longest path. Labels are written each round, nothing is collected.
    """
    one = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = written(one.union(one.select("other", "node")).distinct())
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(spread.join(jump, "label").select("node", F.least("label", "far").alias("label"), (F.col("far") != F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
