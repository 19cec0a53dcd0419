"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, written


def components(links: DataFrame) -> DataFrame:
    """`node`, `label` for the nodes of links (a, b): the smallest node reachable. Repeated links and (a, a) do no harm; an empty table gives an empty one.

    Each round takes the least label of the neighbours, and then twice the label's own label, so that labels run along
    a chain of n nodes in few rounds where they have met before, and in n rounds at worst. Every round ends in a written table; the one before is deleted.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = edges.join(small(labels), F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        new = written(labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was")), "near")
        for _ in range(2):  # the label's own label
            up = small(new.select(F.col("node").alias("at"), F.col("to").alias("up")))
            new_ = written(new.join(up, F.col("to") == F.col("at"), "left").select("node", F.coalesce("up", "to").alias("to"), "was"), "jump")
            dropped(new)
            new = new_
        if new.where("to <> was").isEmpty():
            dropped(new, edges)
            return labels
        dropped(labels)
        labels = written(new.select("node", F.col("to").alias("label")), "labels")
        dropped(new)
