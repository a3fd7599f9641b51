"""Connected components by contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import drop, table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (least node of its component) for every node of a link.

    Each round every node takes the least node among itself and its neighbours,
    and that node's own; links then go between what their ends took, once each,
    and not at all where both took the same.  It ends when no link is left, after
    rounds whose links are ever fewer: each node but the least of its neighbours
    disappears.  Nothing but a count reaches the driver, and each round's links
    and labels are written tables.
    """
    edges = table(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct(), "cc-edges")
    labels = None
    while labels is None or not edges.isEmpty():
        near = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).groupBy("u").agg(F.min("v").alias("m"))
        near = table(near.select("u", F.least("u", "m").alias("l")), "cc-near")
        upper = near.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        taken = table(near.join(upper, "l").select("u", F.col("ll").alias("l")), "cc-taken")
        drop(near)
        x, y = taken.select("u", F.col("l").alias("p")), taken.select(F.col("u").alias("v"), F.col("l").alias("q"))
        moved = edges.join(x, "u").join(y, "v").filter("p <> q")
        left = table(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "cc-edges")
        if labels is None:
            labels = taken
        else:
            # Nodes that are in no link any more keep what they took.
            on = taken.select(F.col("u").alias("l"), F.col("l").alias("to"))
            new = table(labels.join(on, "l", "left").select("u", F.coalesce("to", "l").alias("l")), "cc-labels")
            drop(labels)
            drop(taken)
            labels = new
        drop(edges)
        edges = left
    drop(edges)
    return labels.select(F.col("u").alias("node"), F.col("l").alias("comp"))
