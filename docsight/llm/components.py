"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join, in place, the classes of linked positions; a label is the smallest position of its class."""
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        left, right = left[differ], right[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def _bare(df: DataFrame) -> DataFrame:
    """A materialised table without what the planner knows of its origin: that doubles with each round."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), session)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is the smallest node reachable.

    Each round halves the depth of every tree at least.  Rounds are cut by
    checkpoints, and the minima are materialised before they are joined,
    which leaves both sides of each join free for splitting a hot node.
    Links from a node to itself and null ends are ignored.
    """
    oriented = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(oriented), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = _bare(cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
