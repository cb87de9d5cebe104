"""Connected components of a graph of links, by DataFrame joins: labels fall along links and jump along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm._common import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` (the smallest node reachable) for each node of links; no links give no rows.

    Each round takes the least label among a node's neighbours and then the label of that label, so the rounds grow
    with the logarithm of a path's length, about. Links and labels stay distributed; rounds end when none changes.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    both = stage(both.union(both.select(F.col("v"), F.col("u"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        fell = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = stage(fell.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("higher", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label != old").isEmpty():
            return labels
