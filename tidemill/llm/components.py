"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every node of the edges (a, b): comp is the smallest node of the component.

    Each round takes the smallest label among neighbours, once labels have been followed one step, and ends when
    nothing has changed; labels are written to the shared folder once a round, and the files of the round before are let go. Minima are combined before the shuffle,
    so a node with many neighbours costs no more than its edges. Nulls are not nodes; repeated edges and loops do no
    harm; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null")
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        new = keep(low)
        release(edges.sparkSession)
        if new.where("comp != old").isEmpty():
            return new.select("node", "comp")
        jump = new.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = new.select("node", "comp").join(jump, "comp").select("node", F.least("comp", "next").alias("comp"))
