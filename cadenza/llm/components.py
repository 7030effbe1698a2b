"""Connected components of a link table, by smallest label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, written


def components(links: DataFrame, few: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b longs): the smallest node that it reaches.

    Each round, a node takes the smallest label among its neighbours' and its own, then the label of
    that label (pointer jumping), so long chains shorten by halves. Sums and minima are combined on
    the map side, so a node with very many links is no hot spot. Rounds are written to the shared folder.
    ``few`` is applied to every table that is made: a caller who knows it to be small can coalesce it.
    """
    one = links.select("a", "b").where(F.col("a") != F.col("b"))
    both = written(few(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()), "cc-links")
    labels = written(few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))), "cc-labels")
    while True:
        near = few(both.join(labels.withColumnRenamed("node", "b"), "b")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        took = few(labels.join(near, "node")).select("node", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("top"))
        new = written(few(took.join(up, "c", "left").select("node", F.least("c", F.coalesce("top", "c")).alias("component"), "was")), "cc-labels")
        changed = new.where(F.col("component") != F.col("was")).limit(1).count()
        forget(labels)
        labels = new.drop("was")
        if not changed:
            forget(both)
            return labels
