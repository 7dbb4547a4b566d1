"""Connected components of a table of links, by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node.

    Each round gives a node the least label of its neighbours and then that label's label, so that long chains
    shorten by more than one step a round. Labels stay on executors; each round is a written table.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("now"), "component")
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        moved = written(
            lower.join(jump, F.col("now") == F.col("at"), "left").select(
                "node", F.least("now", F.coalesce("further", "now")).alias("component"), F.col("component").alias("before")
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.where("component != before").isEmpty():
            return labels
