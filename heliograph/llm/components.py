"""Connected components of a set of links, each named by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


#: Rows of a partition of the tables that a round writes; most link sets are small beside the documents.
ROWS = 20_000


def connected_components(links: DataFrame, size: int | None = None) -> DataFrame:
    """(node, component) of every node that occurs in ``links`` (a, b); ``size``: how many links there are, if that is known.

    Each round hooks every node to its smallest neighbour, shortens the pointers until they
    name roots, and goes on with the links between roots; that at least halves the nodes that
    still have links.  Every round's tables are checkpointed, and hold two numbers a node; a large component's members
    meet its root in inner joins, whose uneven partitions AQE splits.
    """
    shared_dir(links.sparkSession)
    both = links.where("a <> b").select("a", "b").distinct()
    both = (both if size is None else both.coalesce(1 + size // ROWS)).checkpoint()
    parts = 1 + both.count() // ROWS
    kept = lambda df: df.coalesce(parts).checkpoint()
    names = kept(both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("component")))
    while not both.isEmpty():
        turned = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = kept(turned.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        while True:  # pointers only fall, so they reach roots
            top = up.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            new = kept(up.join(top, "up").select("node", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            up = new.select("node", "up")
            if not moved:
                break
        names = kept(names.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        a = both.join(up.select(F.col("node").alias("a"), F.col("up").alias("root_a")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("root_b")), "b")
        both = kept(a.where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    return names
