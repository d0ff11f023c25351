"""Chains and components of small relations, by jumps whose number grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.storage import stage


def resolve_chains(mapping: DataFrame) -> DataFrame:
    """(old, new) with every chain followed to its end: a to b and b to c make a to c.

    Of several targets of one row the smallest counts, a row that points at itself is none, and a ring ends at its smallest
    member, which stays. Every round doubles the length of the jumps.
    """
    now = stage(mapping.filter("old <> new").groupBy("old").agg(F.min("new").alias("new")).withColumn("least", F.least("old", "new")))
    total = now.count()
    steps = 1
    while steps <= total:
        nxt = now.select(F.col("old").alias("new"), F.col("new").alias("_new"), F.col("least").alias("_least"))
        after = stage(now.join(nxt, "new", "left").select("old", F.coalesce("_new", "new").alias("new"), F.least("least", F.coalesce("_least", "least")).alias("least"), F.col("_new").isNotNull().alias("_moved")))
        moved = after.filter("_moved").limit(1).count()
        now = after.drop("_moved")
        if not moved:
            break
        steps *= 2
    # what still points at a row with a target is on a ring or leads to one, whose smallest member every walk from it has met
    ring = now.select(F.col("old").alias("new"), F.col("least").alias("_ring"))
    return now.join(ring, "new", "left").select("old", F.coalesce("_ring", "new").alias("new")).filter("old <> new")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): root is the smallest node that a node is connected with.

    Every node takes the smallest root among its own and its neighbours', and roots are then followed to their own roots, until nothing moves.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        # the root of a root, too: what one node has learned its whole tree gets to know
        hung = now.join(near, "node").withColumn("_least", F.least("root", "_near"))
        told = hung.groupBy("root").agg(F.min("_least").alias("_told"))
        jumped = hung.join(told, "root").select("node", F.col("root").alias("_old"), F.least("_least", "_told").alias("root"))
        after = stage(jumped)
        if not after.filter("root <> _old").limit(1).count():
            return after.select("node", "root")
        now = after.select("node", "root")
