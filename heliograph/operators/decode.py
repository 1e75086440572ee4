"""From tag scores to tags: flat and hierarchical decoding.

Going down by depth, a tag is looked at if its parent was accepted or scores 0.60 or more. An accepted parent
scores 0.60 at least, so the gate is the parent's score alone and a scene's families, each headed by its parent's score, replace the walk.
A parent without a score counts 0, which bars the root's children from the first step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import landed
from .taxonomy import ancestors

# Thresholds of the decoder.
LEAF, BRANCH, MARGIN, SIBLINGS = 0.78, 0.60, 0.08, 2


def flat(scores: DataFrame, scene: str, top_k: int, least: float) -> DataFrame:
    """Per scene the best tags by score, at most top_k and none under the least score."""
    rank = F.row_number().over(Window.partitionBy(scene).orderBy(F.desc("score"), "tag_id"))
    return scores.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= top_k)


def hierarchical(scores: DataFrame, tags: DataFrame, scene: str, least: float = 0.0, top_k: int | None = None) -> DataFrame:
    """(scene, tag_id, score, decode_type, rank): direct accepts, then winners among siblings.

    tags: id, parent_id, is_leaf. A tag that only serves as the ancestor of an accepted one isn't given.
    """
    told = tags.select(F.col("id").alias("tag_id"), "parent_id", "is_leaf", F.lit(True).alias("known"))
    heads = tags.select(F.col("parent_id").alias("tag_id")).distinct().withColumn("heads", F.lit(True))
    places = told.join(heads, "tag_id", "full")
    # a score stands in its tag's family and heads the family of its children; a null scene has no parents
    member = F.struct(F.col("parent_id").alias("family"), F.lit(False).alias("head"))
    head = F.struct(F.col("tag_id").alias("family"), F.lit(True).alias("head"))
    stands = F.array_compact(F.array(F.when(F.col("known"), member), F.when(F.col("heads") & F.col(scene).isNotNull(), head)))
    rows = scores.join(places, "tag_id").select(scene, "tag_id", "score", "is_leaf", F.inline(stands))
    family = Window.partitionBy(scene, "family")
    place = F.row_number().over(family.orderBy("head", F.desc("score"), "tag_id"))
    top = F.max(F.when(~F.col("head"), F.col("score"))).over(family)
    parent = F.max(F.when(F.col("head"), F.col("score"))).over(family)
    gated = rows.select("*", place.alias("place"), top.alias("top"), parent.alias("parent_score")).where(~F.col("head"))
    open_ = (F.col("family") == "") | (F.coalesce("parent_score", F.lit(0.0)) >= BRANCH)
    passed = F.col("score") >= F.when(F.col("is_leaf"), LEAF).otherwise(BRANCH)
    wins = (F.col("top") >= LEAF) & (F.col("top") - F.col("score") <= MARGIN) & (F.col("place") <= SIBLINGS)
    judged = gated.select(scene, "tag_id", "score", (open_ & passed).alias("direct"), wins.alias("wins"))
    kept = judged.where((F.col("direct") | F.col("wins")) & (F.col("score") >= least)).select(scene, "tag_id", "score", F.when(F.col("direct"), "direct").otherwise("competition").alias("decode_type"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(scene).orderBy(F.desc("score"), "tag_id")))
    return ranked.where(F.col("rank") <= top_k) if top_k else ranked


def supporting(decoded: DataFrame, tags: DataFrame, scene: str) -> DataFrame:
    """(scene, tag_id) of the suppressed ancestors of decoded tags, by first listed parents.

    The closure starts from the parents of tags, not from the tags: leaves share few parents, and a scene names each once.
    """
    primary = landed(tags.where("parent_id <> ''").select(F.col("id").alias("child_id"), "parent_id"), "primary")
    inner = primary.select(F.col("parent_id").alias("id")).distinct()
    over = ancestors(primary, inner).unionByName(inner.select(F.col("id").alias("node"), F.col("id").alias("ancestor")))
    own = landed(decoded.select(scene, "tag_id"), "decoded")
    # only a tag with children can be its own ancestor
    mine = primary.join(inner.select(F.col("id").alias("child_id"), F.col("id").alias("self")), "child_id", "left")
    parents = own.join(mine, own["tag_id"] == mine["child_id"]).select(scene, "parent_id", "self").distinct()
    up = parents.join(over, parents["parent_id"] == over["node"]).where("self is null or self <> ancestor")
    return up.select(scene, F.col("ancestor").alias("tag_id")).distinct().join(own, [scene, "tag_id"], "left_anti")


def predictions(decoded: DataFrame, tags: DataFrame) -> DataFrame:
    """Decoded tags with name and path; scores rounded after all filters."""
    return decoded.join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"), F.col("path_string").alias("path")), "tag_id").withColumn("score", F.bround("score", 4))


def by_ancestor(tags: DataFrame, key: list[str], path: str = "path", depth: int = 3) -> DataFrame:
    """Tags counted by the third name of paths longer than that, others as ``shallow``; larger groups first."""
    parts = F.split(path, " > ")
    group = F.when(F.size(parts) > depth, F.element_at(parts, depth)).otherwise("shallow")
    return tags.groupBy(*key, group.alias("group_name")).agg(F.count("*").alias("n_tags"), F.array_sort(F.collect_list("tag_id")).alias("tag_ids"))


def by_type(decoded: DataFrame, key: list[str]) -> DataFrame:
    return decoded.groupBy(*key).agg(F.count_if(F.col("decode_type") == "direct").alias("n_direct"), F.count_if(F.col("decode_type") == "competition").alias("n_competition"))
