"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm.tables import meet
from quillspar.session import Workspace


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Each round takes the smallest label among neighbours and then the label of
    that label, so that chains of labels halve; sums and joins only, each
    round's labels written to shared files. The many neighbours of one node and
    the many nodes of one label are dealt over parts. Nodes without links have
    no row.
    """
    space = Workspace(links.sparkSession)
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct()
    both = space.write(both, "links")
    labels = space.write(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels0")
    turn = 0
    while True:
        near = meet(both, labels.select(F.col("node").alias("other"), F.col("label").alias("other_label")), ["other"], ["node"]).groupBy("node").agg(F.min("other_label").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = meet(closer, jump, ["label"], ["node"]).select("node", "old", F.least("label", "next").alias("label"))
        turn += 1
        moved = space.write(moved, f"labels{turn}")
        done = moved.where("label <> old").isEmpty()
        space.drop(f"labels{turn - 1}")
        labels = moved.select("node", "label")
        if done:
            return labels
