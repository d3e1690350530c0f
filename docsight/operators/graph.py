"""Graph operators on edge and community tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bare, cut


def undirected_degree(edges: DataFrame) -> DataFrame:
    """(node, degree) of the distinct undirected edges (src, dst), loops left out."""
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def shared_neighbours(links: DataFrame, least: int = 2, hub: int = 8) -> DataFrame:
    """(a, b, shared): pairs of nodes with ``least`` common neighbours or more; neighbours of degree above ``hub`` say nothing."""
    once = links.select("node", "other").distinct()
    calm = once.groupBy("other").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= hub).select("other")
    kept = once.join(calm, "other")
    a, b = kept.select(F.col("node").alias("a"), "other"), kept.select(F.col("node").alias("b"), "other")
    return a.join(b, "other").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def structure_evidence(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, conflicts, veto) from node profiles (node, pred, other)."""
    p = profile.distinct()
    a = pairs.join(p.withColumnRenamed("node", "a"), "a")
    shared = a.join(p.select(F.col("node").alias("b"), "pred", "other"), ["b", "pred", "other"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    degree = p.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    both = pairs.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    n = both.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    conflicts = F.col("da") + F.col("db") - 2 * F.col("shared")
    return n.select("a", "b", "shared", conflicts.alias("conflicts"), ((conflicts >= 2) & (F.least("da", "db") >= 3)).alias("veto"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (src, dst), by alternating large and small stars.

    Each round links a node's larger neighbours, then its smaller ones, to the
    least of them, which halves the depth of every tree at least; rounds are
    cut by checkpoints.  A node that is linked with itself alone is a
    component; links with a null end are none.
    """
    known = links.filter("src is not null and dst is not null")
    edges, before = bare(cut(known.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = bare(cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
    nodes = known.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(edges.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def community_rollup(members: DataFrame, reports: DataFrame, level: int) -> DataFrame:
    """Reports of each member's deepest community at or above ``level``; members (community, level, member), reports (community, title)."""
    best = members.filter(F.col("level") <= level).groupBy("member").agg(F.max("community").alias("community"))
    return best.select("community").distinct().join(reports, "community")


def size_mix(rows: DataFrame, size: str, bounds: list[int]) -> DataFrame:
    """(bucket, n, share): rows by size bucket; a bucket is named by its lower bound."""
    bucket = F.lit(0)
    for b in bounds:
        bucket = F.when(F.col(size) >= b, F.lit(b)).otherwise(bucket)
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def select_levels(reports: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, community, level, rating, kept): the communities that a level-wise reading selects, for each threshold.

    ``reports`` has community, parent (null at a root), level (0 at a root)
    and rating (null: not rated, never selected).  Reading opens whole levels
    until one holds a rating of the threshold or more; below it, only
    children of selected communities are read.  ``kept`` is false for one
    that a selected child replaced.  One join for each level.
    """
    rated = reports.select("community", "parent", "level", "rating", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")).filter("rating >= threshold")
    opens = rated.groupBy("threshold").agg(F.min("level").alias("opens"))
    rated = rated.join(F.broadcast(opens), "threshold")  # one row a threshold
    depth = rated.agg(F.max("level")).first()[0]
    chosen = row = rated.filter("level = opens")
    for level in range(1, (depth or 0) + 1):
        above = row.filter(F.col("level") == level - 1).select("threshold", F.col("community").alias("parent"))
        row = rated.filter((F.col("level") == level) & (F.col("level") > F.col("opens"))).join(above, ["threshold", "parent"], "left_semi").select(chosen.columns)
        row = cut(row.unionByName(rated.filter((F.col("level") == level) & (F.col("level") == F.col("opens")))))  # or each level's plan would hold all above
        chosen = chosen.unionByName(row.filter("level > opens"))
    replaced = chosen.filter("level > opens").select("threshold", F.col("parent").alias("community")).distinct().withColumn("gone", F.lit(True))
    return chosen.join(replaced, ["threshold", "community"], "left").select("threshold", "community", "level", "rating", F.col("gone").isNull().alias("kept"))


def hierarchy_check(communities: DataFrame) -> DataFrame:
    """(community, role, children): every root and every node whose parent is missing (``dangling``), with its children.

    ``communities``: community, parent; a root has a null or negative parent.
    """
    nodes = communities.select("community", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"))
    known = nodes.select(F.col("community").alias("parent"), F.lit(True).alias("known")).distinct()
    role = F.when(F.col("parent").isNull(), "root").when(F.col("known").isNull(), "dangling")
    odd = nodes.join(known, "parent", "left").withColumn("role", role).filter("role is not null").select("community", "role")
    below = nodes.groupBy(F.col("parent").alias("community")).agg(F.count(F.lit(1)).alias("children"))
    return odd.join(below, "community", "left").select("community", "role", F.coalesce("children", F.lit(0)).alias("children"))


def ego(edges: DataFrame, node) -> DataFrame:
    """(direction, pred, other, n) of one node's edges (src, pred, dst), repeats counted; an edge without an end is ``unary``."""
    around = edges.filter((F.col("src") == node) | (F.col("dst") == node))
    direction = F.when(F.col("dst").isNull(), "unary").when(F.col("src") == node, "out").otherwise("in")
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    return around.groupBy(direction.alias("direction"), "pred", other.alias("other")).agg(F.count(F.lit(1)).alias("n"))
