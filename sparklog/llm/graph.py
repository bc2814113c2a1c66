"""Connected components of a table of links, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, label): the smallest node that can be reached; nodes without a link are left out.

    Each round's edges are a written table in the shared folder; the driver sees counts only.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, written(small, "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        # Equal sums hint at the end; it is the end if no link is new.
        done = now == before and edges.join(old, ["u", "v"], "left_anti").isEmpty()
        drop_written(old)
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links (a, b): only these, between the labels of their ends, are looked through again.

    A node that isn't in labels is its own. The result is a written table.
    """
    for side in "ab":
        of = labels.select(F.col("node").alias(side), F.col("label").alias("_label"))
        links = links.join(of, side, "left").withColumn(side, F.coalesce("_label", side)).select("a", "b")
    new = components(links)
    moved = new.select(F.col("node").alias("label"), F.col("label").alias("_new"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))
    return written(old.unionByName(new.join(labels, "node", "left_anti")), "labels")
