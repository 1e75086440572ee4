"""Scenes and frames: islands, range and nearest joins, top-n, thinning.

Range joins go by time buckets: an interval is listed under each bucket it touches and a point under
its own, so the join is an equi-join with a rest condition, and no side has to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import kept_apart


def islands(rows: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """Rows with ``island``: how many rows up to this one start a new segment (the first always does), from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("__start", (first | F.coalesce(starts, F.lit(False))).cast("int")).withColumn("island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__start")


def cuts(rows: DataFrame, key: str, order: list[str], score: str, time: str, method: str = "content", threshold: float = 27.0, least: float = 0.6, near: int = 2) -> DataFrame:
    """Rows with ``cut``: whether a shot starts here, by given frame scores.

    content: the score reaches the threshold; threshold: it rises to it from below; adaptive: it is so many times the mean of
    the ``near`` frames on either side. A cut counts if it comes at ``least`` seconds after the last one that counts, or later; a
    marked frame that doesn't count holds up none after it. ``order`` identifies a frame of its key and follows time.
    """
    w = Window.partitionBy(key).orderBy(*order)
    s, before = F.col(score), F.lag(score).over(w)
    around = F.sum(score).over(w.rowsBetween(-near, near)) - s
    beside = F.count(score).over(w.rowsBetween(-near, near)) - 1
    if method not in ("content", "threshold", "adaptive"):
        raise ValueError(f"unknown detection method: {method}")
    meant = {"content": s >= threshold, "threshold": (s >= threshold) & (before < threshold), "adaptive": (beside > 0) & (s * beside >= threshold * around)}[method]
    marked = rows.withColumn("__cut", F.coalesce(meant, F.lit(False)))
    kept = kept_apart(marked.where("__cut").select(key, *dict.fromkeys([*order, time])), key, order, time, least).select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in order), F.lit(True).alias("__kept"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(kept, same, "left").withColumn("cut", F.coalesce("__kept", F.lit(False))).drop("__key", "__kept", *(f"__{c}" for c in order))


def fades(rows: DataFrame, key: str, order: list[str], score: str, time: str, threshold: float = 12.0, bias: float = 0.0) -> DataFrame:
    """(key, fade_out, fade_in, cut_at): times of the frames that fall under the threshold and of those that rise to it again.

    The cut lies between both, in the middle or moved by the bias (-1: at the fall, 1: at the rise). A key that starts under
    the threshold falls at its first frame; a fall without a rise makes no pair. Frames without a score count as the one before.
    """
    w = Window.partitionBy(key).orderBy(*order)
    bright = F.last(F.col(score) >= threshold, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = rows.select(key, *dict.fromkeys([*order, time]), bright.alias("__bright")).where("__bright is not null")
    turns = told.withColumn("__before", F.lag("__bright", 1, True).over(w)).where("__bright <> __before")
    pairs = turns.withColumn("fade_out", F.lag(time).over(w)).where("__bright and fade_out is not null")
    return pairs.select(key, "fade_out", F.col(time).alias("fade_in")).withColumn("cut_at", F.col("fade_out") + (F.col("fade_in") - F.col("fade_out")) * ((1 + bias) / 2))


def scenes_of(rows: DataFrame, key: str, time: str) -> DataFrame:
    """key, scene, start, end, duration, n_frames of islands."""
    found = rows.groupBy(key, F.col("island").alias("scene")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_frames"))
    return found.withColumn("duration", F.col("end") - F.col("start"))


def whole_video_where_none(videos: DataFrame, scenes: DataFrame, key: str) -> DataFrame:
    """Scenes; a video without any is one scene from its first to its last frame."""
    none = videos.join(scenes.select(key).distinct(), key, "left_anti")
    made = none.select(key, F.lit(0).cast("long").alias("scene"), F.lit(0).cast("long").alias("start_frame"), (F.col("total_frames") - 1).cast("long").alias("end_frame"), F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return scenes.unionByName(made)


def points_in_spans(points: DataFrame, spans: DataFrame, key: str, time: str, width: float, closed: bool = True) -> DataFrame:
    """Points joined with the spans (start, end) of their key that hold them.

    closed: both ends belong to a span, so a point on a common boundary meets two; else the end doesn't.
    A null end is no end: such a span stays open through every bucket up to its key's last point, so its points are
    met bucket by bucket too, and the points are read once for all spans.  A span without a start, one that ends before it starts and a point without a time meet nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    last = points.groupBy(key).agg(F.max(bucket(time)).alias("__to"))
    bounded = spans.where("end is not null").withColumn("__to", bucket("end"))
    endless = spans.where("end is null").join(last, key)
    listed = bounded.unionByName(endless).where(bucket("start") <= F.col("__to")).withColumn("__bucket", F.explode(F.sequence(bucket("start"), F.col("__to")))).drop("__to")
    before = (F.col(time) <= F.col("end")) if closed else (F.col(time) < F.col("end"))
    inside = (F.col(time) >= F.col("start")) & (F.col("end").isNull() | before)
    return points.withColumn("__bucket", bucket(time)).join(listed, [key, "__bucket"]).where(inside).drop("__bucket")


def nearest_start(points: DataFrame, entries: DataFrame, key: str, point_key: list[str], time: str, start: str = "start", end: str = "end", order: str = "ord") -> DataFrame:
    """For each point the first entry (by order) with start <= t < end, else the entry of least |start - t|, first on ties.

    Entries of a key are laid in time order with the points by a union and two windows: the last start at or
    before the point and the first one after it are the only candidates for the nearest; no pairs are made.
    Entries of a key may not overlap for the first part; overlapping ones need points_in_spans.
    """
    entry = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), (-F.col(order)).alias("neg_ord"))
    first_of = entries.groupBy(key, start).agg(F.min_by(entry, order).alias("entry")).select(key, F.col(start).alias("__t"), F.lit(0).alias("__kind"), "entry", *(F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in point_key))
    asked = points.select(key, F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(dict(first_of.dtypes)["entry"]).alias("entry"), *point_key)
    w = Window.partitionBy(key).orderBy("__t", "__kind")
    before = F.last("entry", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("__kind"))  # a running frame; one that looks ahead would be taken anew for each row
    after = F.last("entry", ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    laid = first_of.unionByName(asked).select("*", before.alias("__before"), after.alias("__after")).where("__kind = 1")
    b, a, t = F.col("__before"), F.col("__after"), F.col("__t")
    nearer = (a["start"] - t < t - b["start"]) | ((a["start"] - t == t - b["start"]) & (a["neg_ord"] > b["neg_ord"]))
    chosen = F.when(b.isNull(), a).when(a.isNull() | (t < b["end"]), b).when(nearer, a).otherwise(b)
    return laid.select(key, *point_key, t.alias(time), chosen["start"].alias("entry_start"), (-chosen["neg_ord"]).alias("entry_ord"))


def top_n(rows: DataFrame, key: list[str], score: str, order: list[str], n: int, least: float | None = None) -> DataFrame:
    """The n best rows of each key, ties in the given order; rows under ``least`` never count."""
    rows = rows.where(F.col(score) >= least) if least is not None else rows
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), *order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def thin(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """At most k rows a key, at places int(i * (n / k)) of its order; a place is kept if some i < k maps to it."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("__pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    step = F.col("__n").cast("double") / k
    i = F.ceil(F.col("__pos") / step)
    hit = lambda j: (j < k) & (F.floor(j * step) == F.col("__pos"))  # noqa: E731  i or, after rounding, its neighbours
    return rows.where((F.col("__n") <= k) | hit(i) | hit(i - 1) | hit(i + 1)).drop("__pos", "__n")


def keep_selected(frames: DataFrame, selected: DataFrame, key: list[str]) -> DataFrame:
    """Frames whose index was selected, with the selection's score."""
    return frames.join(selected, key)
