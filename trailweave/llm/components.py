"""Connected components of links between nodes, by rounds of least labels and jumps; all of it stays in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of any one orderable type -> node, label: the least node that can be reached. Nodes without a link are left out.

    In a round each node takes the least label among its own and its neighbours', then its label's label. A
    chain of length n takes about log n rounds. Null nodes and loops are ignored; repeated links do no harm.
    """
    sound = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = written(sound.union(sound.select("b", "a")).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jumped = written(own)
        to = jumped.select(F.col("node").alias("_to"), F.col("label").alias("_far"))
        new = written(jumped.join(to, jumped.label == to["_to"]).select("node", "was", F.least("label", "_far").alias("label")))
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) of components() and further links (a, b) of nodes, with or without a label -> node, label with all of them.

    Only the components that the new links touch are gone through again.
    """
    label = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))

    def whole(side: str) -> Column:
        return F.coalesce(f"{side}._l", f"links.{side}").alias(side)

    ends = links.alias("links").join(label.alias("a"), F.col("links.a") == F.col("a._n"), "left").join(label.alias("b"), F.col("links.b") == F.col("b._n"), "left")
    merged = components(ends.select(whole("a"), whole("b")))
    now = merged.select(F.col("node").alias("_m"), F.col("label").alias("_now"))
    known = labels.join(now, labels.label == now["_m"], "left").select("node", F.coalesce("_now", "label").alias("label"))
    return written(known.union(merged.join(labels, "node", "left_anti")))
