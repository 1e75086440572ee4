"""Sampling times, scene candidates and other arithmetic of intervals (seconds, double)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_of(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(0.0)


def adaptive_step(duration: Column, step: Column) -> Column:
    """At least 20 samples of a video shorter than 20 s, but no finer than 0.1 s."""
    finer = F.greatest(duration / 20.0, F.lit(0.1))
    return F.when((duration < 20.0) & (finer < step), finer).otherwise(step)


def interval_times(duration: Column, step: Column) -> Column:
    """0, step, ... below the duration, each clamped to duration - 0.1.

    Times are the running sum of steps, not multiples: the sum's drift may give one more time.
    """

    @F.pandas_udf("array<double>")
    def times(durations: pd.Series, steps: pd.Series) -> pd.Series:
        out = []
        for d, s in zip(durations, steps, strict=True):
            if pd.isna(d) or pd.isna(s) or s <= 0:
                out.append(None)
                continue
            t = np.concatenate(([0.0], np.cumsum(np.full(max(0, int(np.ceil(d / s))) + 1, s))))  # one after the other, as a loop would
            out.append(np.minimum(t[t < d], d - 0.1))
        return pd.Series(out)

    return times(duration.cast("double"), step.cast("double"))


def scene_times(starts: Column, ends: Column, duration: Column) -> Column:
    """25, 50 and 75 % of each scene, times at or past the duration left out."""
    each = F.flatten(F.zip_with(starts, ends, lambda a, b: F.transform(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda q: a + (b - a) * q)))
    return F.transform(F.filter(each, lambda t: t < duration), lambda t: F.least(t, duration - 0.1))


def scene_candidates(start: Column, end: Column, n: Column) -> Column:
    """n candidate times of a scene: its middle; 10 and 90 %; else the middles of n equal parts."""
    length = end - start
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: start + length * ((i + 0.5) / n))
    return F.when(n == 1, F.array(start + length / 2.0)).when(n == 2, F.array(start + length * 0.1, start + length * 0.9)).otherwise(parts)


def candidate_count(n: Column, multiplier: Column, sharpest: Column, has_scenes: Column) -> Column:
    """Frames to extract of a scene: n, or multiplier times as many where the sharpest of them is to be chosen."""
    return F.when(sharpest & has_scenes, n * multiplier).otherwise(n)


def sorted_unique(times: Column) -> Column:
    return F.array_sort(F.array_distinct(times))


def estimated_scenes(duration: Column) -> Column:
    return F.when(duration > 0, F.greatest(F.lit(1), F.floor(duration / 3.0))).otherwise(0).cast("long")


def estimated_frames(duration: Column, step: Column, by_scene: bool = False) -> Column:
    return estimated_scenes(duration) * 3 if by_scene else F.floor(duration / step).cast("long")


def linspace16(n: Column) -> Column:
    """Places (0-based) of 16 evenly spread of n rows, truncated."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(i * (n - 1) / 15).cast("int"))


def resample16(items: Column) -> Column:
    """Exactly 16 items: spread over the array, or its last one repeated; an empty array stays so."""
    n = F.size(items)
    spread = F.transform(linspace16(n), lambda i: F.get(items, i))
    padded = F.concat(items, F.array_repeat(F.try_element_at(items, F.lit(-1)), 16 - n))
    return F.when(n == 0, items).when(n >= 16, spread).otherwise(padded)


def even_places(n: Column, k: Column) -> Column:
    """Places i * (n / k) for i < k, truncated; all places if there are no more than k."""
    step = n.cast("double") / k
    return F.when(n > k, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * step).cast("int"))).otherwise(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))


def contain(container_w: Column, container_h: Column, width: Column, height: Column) -> Column:
    """struct(scale_x, scale_y, offset_x, offset_y) of a frame shown whole and centred in a container."""
    wider = width / height > container_w / container_h
    w = F.when(wider, container_w.cast("double")).otherwise(container_h * (width / height))
    h = F.when(wider, container_w / (width / height)).otherwise(container_h.cast("double"))
    return F.struct((w / width).alias("scale_x"), (h / height).alias("scale_y"), ((container_w - w) / 2).alias("offset_x"), ((container_h - h) / 2).alias("offset_y"))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    both = w * h
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)
