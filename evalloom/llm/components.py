"""Connected components of links that no task sees as a whole: alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import written


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links (a, b), the smallest node that each reaches."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (before == label).all():
            break
    return label


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)).alias("s")).first()
    return row["n"], row["x"], row["s"]


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b: long) but the roots; root is the smallest node that node reaches.

    Each round replaces a node's links by links to its smallest neighbour, so paths shorten fast and hubs stay the only
    large groups; these are aggregated before any shuffle and joined under the engine's splitting of skewed partitions.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = written(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = written(small, "small-stars")
        now = _state(links)
        if now == state or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
