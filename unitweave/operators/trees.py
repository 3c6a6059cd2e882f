"""Trees of any depth by pointer doubling.

Round k knows of each node its ancestor 2^k above, and whatever is kept has gone up by less
than 2^k levels; one join brings it to twice that. A tree of depth d takes log2(d) rounds,
each a written table. A ring of nodes, which has ancestors without end, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.sources.work import settle

Lift = Callable[[DataFrame, DataFrame], DataFrame]


def ladder(nodes: DataFrame) -> list[DataFrame]:
    """Written jumps (node, above, by) of nodes (node_id, parent_id, by): the k-th table 2^k levels up, as many as there are.

    A parent without a row of its own is above its children and below nothing; a null
    parent is none. A null `by` stays null in every jump over it.
    """
    steps = [settle(nodes.where("node_id IS NOT NULL AND parent_id IS NOT NULL").select(F.col("node_id").alias("node"), F.col("parent_id").alias("above"), F.col("by").cast("long").alias("by")), "jumps-0")]
    edges = steps[0].count()
    while not (jumps := steps[-1]).isEmpty():
        k = len(steps)
        if 1 << k - 1 > edges:
            ring = sorted(str(r.node) for r in jumps.select("node").limit(3).collect())
            raise ValueError(f"nodes are above themselves, or below ones that are: {', '.join(ring)}")
        upper = jumps.select(F.col("node").alias("n2"), F.col("above").alias("a2"), F.col("by").alias("b2"))
        steps.append(settle(jumps.join(upper, F.col("above") == F.col("n2")).select("node", F.col("a2").alias("above"), (F.col("by") + F.col("b2")).alias("by")), f"jumps-{k}"))
    return steps[:-1]


def ascend(steps: Iterable[DataFrame], start: DataFrame, lift: Lift) -> DataFrame:
    """What `start` comes to when it has gone up all levels of a ladder.

    lift(known, jumps) adds to what is known within some levels what `jumps` (node,
    above, by: the way `by` adds up) carry up by as many.
    """
    known = start
    for k, jumps in enumerate(steps):
        known = settle(lift(known, jumps), f"known-{k}")
    return known


def climb(nodes: DataFrame, start: DataFrame, lift: Lift) -> DataFrame:
    """ascend() on the ladder of nodes (node_id, parent_id, by)."""
    return ascend(ladder(nodes), start, lift)


def edges_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", "parent_id", F.lit(0).alias("by"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id, distance, for every node and each node above it."""
    up = nodes.select("node_id", "parent_id", F.lit(1).alias("by"))
    itself = up.where("node_id IS NOT NULL").select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).cast("long").alias("distance"))

    def lift(known: DataFrame, jumps: DataFrame) -> DataFrame:
        higher = known.join(jumps, F.col("ancestor_id") == F.col("node")).select("node_id", F.col("above").alias("ancestor_id"), (F.col("distance") + F.col("by")).alias("distance"))
        return known.unionByName(higher)

    return climb(up, itself, lift).where("distance > 0")
