"""Tag taxonomies as node and edge tables: paths, enrichment, roots, closures.

Recursion runs level by level as joins on the edge table; every level is a checkpointed DataFrame. It ends when a
level brings nothing new, however deep the taxonomy: closures leave out what they have reached before, and
paths never enter a tag that they hold already, so a cycle ends too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder, landed


def levels(start: DataFrame, step, new_by: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """Union of start and what step gives of each level, until a level is empty or the depth is reached.

    new_by: columns of which only combinations that no earlier level had go on.
    """
    checkpoint_folder(start.sparkSession)
    level = start.checkpoint()
    found = [level]
    while depth is None or len(found) <= depth:
        level = step(level)
        if new_by:
            level = level.join(reduce(DataFrame.unionByName, found).select(*new_by), new_by, "left_anti").select(*start.columns)
        level = level.checkpoint()
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def descendants(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, depth) reachable downward over any parent, roots included; the smallest depth counts."""
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    step = lambda x: x.join(edges, x["node"] == edges["parent_id"]).select("root", F.col("child_id").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
    return levels(start, step, ["root", "node"], depth)


def ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor) over the given edges (primary ones for the decoder's closure), the node itself left out."""
    start = nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor")).distinct()
    step = lambda x: x.join(edges, x["ancestor"] == edges["child_id"]).select("node", F.col("parent_id").alias("ancestor")).distinct()
    return levels(start, step, ["node", "ancestor"]).where("node <> ancestor")


def root_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The parentless node with most descendants, itself counted; the first (ord) on ties."""
    tops = nodes.join(edges.select(F.col("child_id").alias("id")).distinct(), "id", "left_anti")
    sizes = descendants(edges, tops.select("id")).groupBy("root").agg(F.countDistinct("node").alias("n_nodes"))
    ranked = sizes.join(tops.select(F.col("id").alias("root"), "ord"), "root")
    return ranked.agg(F.max_by(F.struct("root", "n_nodes"), F.struct("n_nodes", -F.col("ord"))).alias("r")).select("r.root", "r.n_nodes")


def within(nodes: DataFrame, edges: DataFrame, root_id: str) -> DataFrame:
    """Nodes under a root over any parent; the root stays."""
    reach = descendants(edges, nodes.where(F.col("id") == root_id).select("id"))
    return nodes.join(reach.select(F.col("node").alias("id")), "id", "left_semi")


def family(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Members within two levels of each head."""
    return descendants(edges, heads, depth=2)


def paths(nodes: DataFrame, edges: DataFrame, root_id: str) -> DataFrame:
    """(id, path, ords): every name path from the root to a parent of the node; the root's name is in, the node's not.

    ords are the parents' places from the node upward and order a node's paths as a walk of its parents would.
    """
    named = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    up = edges.join(named, "parent_id")
    empty = F.array().cast("array<string>")
    start = nodes.where(F.col("id") == root_id).select(F.col("id").alias("at"), empty.alias("path"), F.array().cast("array<int>").alias("ords"), empty.alias("over"))

    def step(x: DataFrame) -> DataFrame:
        met = x.join(up, (x["at"] == up["parent_id"]) & (x["at"] != up["child_id"]) & ~F.array_contains(x["over"], up["child_id"]))
        return met.select(F.col("child_id").alias("at"), F.concat("path", F.array("parent_name")).alias("path"), F.concat(F.array(F.col("ord").cast("int")), F.col("ords")).alias("ords"), F.concat("over", F.array("at")).alias("over"))

    return levels(start, step).select(F.col("at").alias("id"), "path", "ords").where(F.col("id") != root_id)


def shortest(nodes: DataFrame, edges: DataFrame, root_id: str) -> DataFrame:
    """(id, path, ords): the shortest name path from the root to a parent of each tag below it, the first by ords on ties.

    By levels: a tag's shortest path goes on from a shortest path of a parent, so each tag is reached once and holds one path.
    """
    named = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    up = edges.where("child_id <> parent_id").join(named, "parent_id")
    start = nodes.where(F.col("id") == root_id).select("id", F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("ords"))

    def step(x: DataFrame) -> DataFrame:
        met = x.join(up, x["id"] == up["parent_id"])
        longer = met.select(F.col("child_id").alias("id"), F.concat("path", F.array("parent_name")).alias("path"), F.concat(F.array(F.col("ord").cast("int")), "ords").alias("ords"))
        return longer.groupBy("id").agg(F.min_by("path", "ords").alias("path"), F.min("ords").alias("ords")).select("id", "path", "ords")

    return levels(start, step, ["id"]).where(F.col("id") != root_id)


def path_counts(nodes: DataFrame, edges: DataFrame, root_id: str) -> DataFrame:
    """(id, n_paths, longest): how many paths lead from the root to each tag below it, and how many steps the longest has.

    By topological levels: a tag is counted once all its parents that the root reaches are, so work grows with the edges, not the paths.
    Tags on a cycle, or below one, are left out: their paths without repetition can only be listed. Edges told twice count once.
    """
    reach = descendants(edges, nodes.where(F.col("id") == root_id).select("id")).select(F.col("node").alias("parent_id"))
    live = landed(edges.where((F.col("child_id") != F.col("parent_id")) & (F.col("child_id") != root_id)).select("child_id", "parent_id").distinct().join(reach, "parent_id", "left_semi"))
    parents = live.groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("n_parents"))
    settled = nodes.where(F.col("id") == root_id).select("id", F.lit(1).cast("decimal(38,0)").alias("n_paths"), F.lit(0).alias("longest"))
    found, waiting = [settled], None
    while not settled.isEmpty():
        given = live.join(settled.withColumnRenamed("id", "parent_id"), "parent_id").select(F.col("child_id").alias("id"), "n_paths", (F.col("longest") + 1).alias("longest"), F.lit(1).cast("long").alias("seen"))
        both = given if waiting is None else given.unionByName(waiting)
        sums = landed(both.groupBy("id").agg(F.sum("n_paths").cast("decimal(38,0)").alias("n_paths"), F.max("longest").alias("longest"), F.sum("seen").alias("seen")).join(parents, "id"))
        settled = sums.where("seen = n_parents").select("id", "n_paths", "longest")
        waiting = sums.where("seen < n_parents").select("id", "n_paths", "longest", "seen")
        found.append(settled)
    return reduce(DataFrame.unionByName, found).where(F.col("id") != root_id)


def summary(nodes: DataFrame, edges: DataFrame, root_id: str) -> DataFrame:
    """id, name, path (the shortest, first on ties), path_string, depth, path_count, parent_id (first listed), all_parent_ids, is_leaf.

    As ``enrich``, but paths are counted, not listed: path_count is null on and below a cycle, and 1 (the empty path) for a tag that the root doesn't reach.
    """
    best, counted = shortest(nodes, edges, root_id), path_counts(nodes, edges, root_id).select("id", "n_paths")
    rows = nodes.join(best, "id", "left").join(counted, "id", "left").join(_parents(edges), "id", "left").join(_inner(edges), "id", "left")
    count = F.when(F.col("path").isNull(), F.lit(1)).otherwise(F.col("n_paths")).cast("decimal(38,0)")
    return rows.select("id", "name", *_way(), count.alias("path_count"), *_told())


def located(nodes: DataFrame, edges: DataFrame, root_id: str) -> DataFrame:
    """``summary`` without path_count: paths aren't counted."""
    rows = nodes.join(shortest(nodes, edges, root_id), "id", "left").join(_parents(edges), "id", "left").join(_inner(edges), "id", "left")
    return rows.select("id", "name", *_way(), *_told())


def first_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, parent_id (first listed), is_leaf: what a decoder needs, without a walk from the root."""
    first = edges.groupBy(F.col("child_id").alias("id")).agg(F.min(F.struct("ord", "parent_id"))["parent_id"].alias("parent_id"))
    rows = nodes.join(first, "id", "left").join(_inner(edges), "id", "left")
    return rows.select("id", "name", F.coalesce("parent_id", F.lit("")).alias("parent_id"), F.col("has_children").isNull().alias("is_leaf"))


def _way() -> list[Column]:
    path = F.coalesce("path", F.array().cast("array<string>"))
    return [path.alias("path"), F.array_join(path, " > ").alias("path_string"), F.size(path).alias("depth")]


def _parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("child_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "parent_id"))).alias("parents"))


def _inner(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))


def _told() -> list[Column]:
    first = F.coalesce(F.get("parents", F.lit(0))["parent_id"], F.lit(""))
    every = F.coalesce(F.transform("parents", lambda p: p["parent_id"]), F.array().cast("array<string>"))
    return [first.alias("parent_id"), every.alias("all_parent_ids"), F.col("has_children").isNull().alias("is_leaf")]


def enrich(nodes: DataFrame, edges: DataFrame, root_id: str) -> DataFrame:
    """id, name, path (the shortest, first on ties), path_string, all_paths, depth, path_count, parent_id (first listed), all_parent_ids, is_leaf.

    Lists every path, which may be exponential in the tags; ``summary`` counts them instead. A tag without a path has the empty path alone.
    """
    found = paths(nodes, edges, root_id).groupBy("id").agg(
        F.min_by("path", F.struct(F.size("path"), "ords")).alias("path"), F.array_sort(F.collect_list(F.struct("ords", "path"))).alias("all"),
    )
    rows = nodes.join(found, "id", "left").join(_parents(edges), "id", "left").join(_inner(edges), "id", "left")
    empty = F.array().cast("array<string>")
    every = F.coalesce(F.array_distinct(F.transform("all", lambda p: p["path"])), F.array(empty))
    path = F.coalesce("path", empty)
    return rows.select("id", "name", path.alias("path"), F.array_join(path, " > ").alias("path_string"), every.alias("all_paths"), F.size(path).alias("depth"), F.size(every).alias("path_count"), *_told())


def stats(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count("*").alias("n_tags"), F.count_if("is_leaf").alias("n_leaves"), F.count_if(~F.col("is_leaf")).alias("n_branches"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
