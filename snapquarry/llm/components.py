"""Connected components of a link table, without collecting links or labels.

Every round each node points to its smallest neighbour, pointers are followed, and the links
are rewritten between the nodes pointed to; links within a node vanish.  The graph at least
halves in each round.  Links of a node with very many neighbours are spread by the other
end: the minimum is pre-aggregated before each shuffle and joins on a hot node are left to
adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, materialise


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for the nodes of ``links`` (``a``, ``b``).

    Nulls, self-links and repeated links have no effect; no links give no rows.
    """
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels = None
    while True:
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        smallest = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p"))
        # one jump along the pointers keeps chains short
        jump = smallest.select(F.col("n").alias("p"), F.col("p").alias("q"))
        pointer = materialise(smallest.join(jump, "p").select("n", F.col("q").alias("p")), f"{name}-pointers")
        moved = edges.join(pointer.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a").join(pointer.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
        rest = materialise(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-links")
        if labels is None:
            merged = pointer.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            step = pointer.select(F.col("n").alias("component"), F.col("p").alias("next"))
            merged = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        old, labels = labels, materialise(merged, f"{name}-labels")
        for gone in (edges, pointer, old):
            if gone is not None:
                drop_table(gone)
        edges = rest
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
