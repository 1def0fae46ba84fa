"""Connected components of a table of links, by alternating large and small stars."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.staging import scratch, staged


def _oriented(pairs: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (u, v); component is the smallest node reachable.

    Each round links the larger neighbours of a node with its smallest one, then all smaller ones and the node with
    the smallest. The links shrink to stars around the smallest nodes in a number of rounds that grows with the
    logarithm of the nodes. Minima are summed per task first; a node with very many links is split by the adaptive
    skew join. Null ends and self-links are ignored.
    """
    with scratch(links.sparkSession) as own:
        edges = staged(_oriented(links), "links")
        seen = None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = _oriented(both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
            large = staged(large, "links")
            lowest = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            before, edges = edges, staged(_oriented(small.select("e.*")), "links")
            own.drop(before, large)
            state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
            if state == seen:
                break
            seen = state
        own.keep(edges)
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, of n nodes with links a-b, within one task."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label
