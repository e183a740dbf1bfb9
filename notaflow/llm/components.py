"""Connected components by contraction, without collecting edges anywhere.

Defined cases: an edge with a null or with equal ends is none; repeated edges, in either direction, are one; nodes without an
edge are in no row; no edges give no rows; other columns than a and b are ignored. Rounds grow about with the logarithm of a
component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for edges a, b.

    Each round every node points at its smallest neighbour, pointers are followed once more, and edges are drawn anew
    between what their ends point at; equal ends go. Each round is a stored table. Minima are partially aggregated
    before the shuffle, so a node of any degree is no burden.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    names = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        point = stored(point, "cc-point")
        again = point.select(F.col("node").alias("n2"), F.col("to").alias("to2"))
        point = stored(point.join(again, F.col("to") == F.col("n2")).select("node", F.col("to2").alias("to")), "cc-jump")
        names = point.select("node", F.col("to").alias("root")) if names is None else names.join(point.withColumnRenamed("node", "n1"), F.col("root") == F.col("n1"), "left").select("node", F.coalesce("to", "root").alias("root"))
        names = stored(names, "cc-names")
        pa, pb = point.toDF("a", "pa"), point.toDF("b", "pb")
        left = left.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = stored(left, "cc-edges")
    return names if names is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
