"""Connected components of links, as joins and sums on the links' table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.store import handed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``: the smallest node reachable from it.

    Each round gives a node the smallest label around it and then that label's own label, so chains shrink by more
    than half a round; a label's rows are summed before they are shuffled, and each round's labels are written to the
    shared folder.
    """
    both = handed(links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        links.select(F.col(b).alias("node"), F.col(a).alias("other"))).filter("node <> other").distinct(), "links")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))
    while True:
        labels = handed(labels, "labels")
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = handed(lower.join(up, "c", "left").select("node", "was", F.least(F.col("c"), F.coalesce("up", "c")).alias("component")), "labels")
        if not new.filter("component <> was").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
