"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.skew import split_join
from tessella.llm.storage import columns_of, discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the least node of its component.

    Each round gives a node the least label among its neighbours' and then that label's own label, so
    that a path of length n needs about log n rounds. Nodes with many links and labels of many nodes are
    dealt over tasks. A label table is written each round and the one before it deleted; only the
    number of changes comes to the driver.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = written(both, "links")
    degrees = written(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "degrees")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        at = labels.select(F.col("node").alias("b"), F.col("label").alias("seen")).join(degrees, "b")
        least = split_join(both, at, "b", "n", "a", "inner").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = labels.join(least, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        many = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next")).join(many, "label")
        step = split_join(step, jump, "label", "n", "node").select("node", "old", F.least("label", "next").alias("label"))
        step = written(step, "labels")
        discard(labels)
        labels = columns_of(step, "node", "label")
        if not step.where("label <> old").limit(1).count():
            discard(both, degrees)
            return labels
