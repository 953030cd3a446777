"""Connected components of an edge table by repeated smallest-label steps.

Every round each node takes the smallest label among itself and its neighbours and then the
label of that label (pointer jumping), so a path of length L needs about log L rounds.  Labels
and edges stay distributed; only the number of changed nodes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import released


def components(edges: DataFrame, by_node: Callable[[DataFrame], DataFrame] = lambda df: df,
               max_rounds: int = 100) -> DataFrame:
    """(node, label): ``label`` is the smallest node of the component; nodes without an edge
    are absent.  ``edges``: (a, b) of one comparable type, undirected, without nulls.

    ``by_node`` may hint a broadcast for tables of a row a node, where the caller knows that the
    nodes are few.  A hub's edges are combined map-side before the shuffle, so one node with a third of all
    edges does not land in one task as raw rows.
    """
    both = (edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
            .union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
            .where(F.col("node") != F.col("to")).distinct())
    both = released(both)
    labels = (both.groupBy("node").agg(F.min("to").alias("near"))
              .select("node", F.least("node", "near").alias("label")))
    labels = released(labels)
    for _ in range(max_rounds):
        to = labels.select(F.col("node").alias("to"), F.col("label").alias("to_label"))
        near = both.join(by_node(to), "to").groupBy("node").agg(F.min("to_label").alias("near"))
        stepped = (labels.join(by_node(near), "node")
                   .select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = released(stepped.join(by_node(up), "label").select("node", "was", F.least("label", "up").alias("label")))
        changed = nxt.where(F.col("was") != F.col("label")).limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
