"""Connected components of a graph given as edges, by alternating large-star and small-star contraction.

A large-star step links every larger neighbour of a node to the smallest node around it, a small-star step every smaller one. The edges turn
into stars around the smallest node of each component after a number of rounds that grows with the logarithm of its size. Each round is a
grouped minimum (combined before its shuffle, so a hub costs a row per task) and a join that adaptive execution splits at a hub; its edges are
written to the shared folder, so that a lost executor costs part of a round. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges (a long, b long)``: the smallest node that it is connected to. Loops and repeats do no harm."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = common.written(pairs, "edges")
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = common.written(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
