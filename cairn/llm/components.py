"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the least vertex of its component.

    Each round takes the least label among neighbours and then the label of that label, which halves what is left of
    a path. Only a count of changed labels goes to the driver; every round is a written table.
    """
    both = store.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = store.keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("c")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("n"))
        step = labels.join(near, "v").select("v", "c", F.least("c", "n").alias("n"))
        jump = labels.select(F.col("v").alias("n"), F.col("c").alias("j"))
        new = store.keep(step.join(jump, "n").select("v", F.least("n", "j").alias("c"), (F.least("n", "j") != F.col("c")).alias("changed")))
        changed = new.filter("changed").limit(1).count()
        store.drop(labels)
        labels = new.select("v", "c")
        if not changed:
            return labels
