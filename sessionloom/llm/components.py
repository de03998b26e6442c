"""Connected components of an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Each round a node takes the least label next to it and then the label of its
    label, so the rounds grow with the logarithm of the diameter. Labels and edges
    stay in tables of the shared folder; the driver sees one count a round. Raises
    RuntimeError if `most` rounds do not settle (never with pointer jumps on any
    graph of under 2**60 nodes in practice). No edges: no rows. Null ends are ignored.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    n = 2 * both.count()
    both = C.written(both.union(both.select("v", "u")).distinct(), "links", rows=n)
    labels = C.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), "labels", rows=n)
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = C.written(step, "labels", rows=n)
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
