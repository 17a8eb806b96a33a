"""Connected components of links: least labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node it is linked with over any way) for every node of links (a, b).

    Each round takes the least label of the neighbours, then the label of the label. After k rounds every node has at most
    the least node within k steps, so rounds never exceed the longest of the shortest ways; jumps make them far fewer in
    most graphs, without a proven bound. Each round is written, so no lineage builds up. Many nodes with one label meet in
    a join, whose large partitions adaptive execution splits.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = nearer.join(jumps, "label").select("node", "old", F.least("label", "further").alias("label"))
        new = written(new, "labels")
        settled = new.where("label < old").isEmpty()
        labels = new.select("node", "label")
        if settled:
            return labels
