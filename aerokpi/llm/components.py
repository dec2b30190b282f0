"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerokpi.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected links (a, b): the label is the smallest
    node reachable.

    Each round gives a node the smallest label around it and then follows labels to their
    own labels, so long chains shorten by powers of two. Labels are a written table; joins
    run on tables as they are written, so Spark can split a hub's rows, and the minimum is
    aggregated before it is shuffled. The driver sees one flag a round."""
    spark = links.sparkSession
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = written(labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "near").alias("near")), "near")
        own = nearer.select(F.col("node").alias("of"), F.col("near").alias("far"))
        new = written(nearer.join(own, nearer["near"] == own["of"]).select("node", F.least("near", "far").alias("label"),
                                                                       (F.least("near", "far") < F.col("label")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        discard(spark, labels, nearer)
        labels = new.select("node", "label")
        if not moved:
            discard(spark, both)
            return labels
