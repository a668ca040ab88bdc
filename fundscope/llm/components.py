"""Connected components of a table of links, by rounds of minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) of every node with a link. Self links are allowed."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = written(edges.union(edges.select(F.col("v"), F.col("u"))).distinct(), "links")
    labels = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("seen"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = (labels.join(near, labels["node"] == near["u"]).join(jump, "root", "left")
               .select("node", F.least("root", "seen", "above").alias("next"), "root"))
        new = written(new, "labels")
        changed = new.where(F.col("next") != F.col("root")).limit(1).count()
        labels = new.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
