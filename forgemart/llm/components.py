"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgemart.llm.scratch import saved


def merge_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of the nodes a[i] and b[i] in `parent`, in which a root is its own parent
    and the least node of its tree. Works in place; afterwards every node points to its root."""
    while len(a):
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        left = parent[a] != parent[b]
        a, b = a[left], b[left]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the least node that links lead to.

    Large-star and small-star steps (Kiveris et al. 2014) until no link changes; a step's tables are
    written to shared storage, and the least neighbours are such a table, so that both sides of
    each join are plain exchanges that adaptive execution can split at nodes of many links.
    Links from a node to itself, repeated links and nulls are allowed; those give no rows alone.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def least(df: DataFrame) -> DataFrame:
        return saved(df.groupBy("a").agg(F.min("b").alias("m")))

    links = saved(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    was = state(links)
    if not was[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = saved(
            both.join(least(both), "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        near = least(large)
        small = (
            large.join(near, "a")
            .where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        links = saved(small.union(near.select("a", F.col("m").alias("b"))).distinct())
        now = state(links)
        if now == was:
            break
        was = now
    # Every node but a root now has one link, to its root.
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
