"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def join_labels(n: int, one: np.ndarray, two: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable place of each of n places, given edges between them:
    roots hook to smaller roots, then every label is followed to its root."""
    label = np.arange(n) if label is None else label
    a, b = label[one], label[two]
    while len(a := a[(apart := a != b)]):
        b = b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
        a, b = label[a], label[b]
    return label


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b of one integer
    type): root is the same for two nodes exactly if a path joins them.

    Each round hooks every root to its smallest smaller neighbour and follows
    the hooks by pointer doubling, so the roots that still have an edge at
    least halve. All steps are aggregates (partial before their shuffle) and
    equi-joins between stored tables, whose hot keys AQE splits; nothing is
    collected but counts. No edges: no rows. Self-loops and repeated edges
    change nothing; edges with a null end are ignored.
    """
    rest = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    members = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while rest.limit(1).count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.filter("b < a").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = hooks.join(up, "root", "left")
            if not moved.filter("next IS NOT NULL").limit(1).count():
                break
            hooks = stored(moved.select("node", F.coalesce("next", "root").alias("root")), "hooks")

        def through(df: DataFrame, col: str) -> DataFrame:
            to = hooks.select(F.col("node").alias(col), F.col("root").alias("next"))
            return df.join(to, col, "left").withColumn(col, F.coalesce("next", col)).drop("next")

        members = stored(through(members, "root"), "members")
        rest = stored(through(through(rest, "a"), "b").filter("a <> b").distinct(), "edges")
    return members.select("node", "root")
