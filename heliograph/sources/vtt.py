"""Sprite cues out of WebVTT texts, a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two readings of a cue.
STRICT = r"^(\d{2}):(\d{2}):(\d{2}\.\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2}\.\d{3})"
LOOSE = r"(\d+):(\d+):(\d+)\.(\d+)\s*-->\s*(\d+):(\d+):(\d+)\.(\d+)"
XYWH = r"#xywh=(\d+),(\d+),(\d+),(\d+)"


def _box(line: Column) -> list[Column]:
    return [F.regexp_extract(line, XYWH, i + 1).cast("int").alias(n) for i, n in enumerate("xywh")]


def strict_cues(texts: DataFrame, key: str, vtt: str = "vtt") -> DataFrame:
    """Blocks between blank lines: times on the first line, box on the second; others are skipped."""
    blocks = texts.select(key, F.posexplode(F.split(F.trim(F.regexp_replace(vtt, r"^\s+|\s+$", "")), "\n\n")).alias("ord", "block"))
    lines = blocks.withColumn("lines", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n")).where(F.size("lines") >= 2)
    head, box = F.get("lines", F.lit(0)), F.get("lines", F.lit(1))
    good = lines.where(~head.startswith("WEBVTT") & head.rlike(STRICT) & box.rlike(XYWH))
    at = lambda i: F.regexp_extract(head, STRICT, i).cast("int") * 3600 + F.regexp_extract(head, STRICT, i + 1).cast("int") * 60 + F.regexp_extract(head, STRICT, i + 2).cast("double")
    return good.select(key, "ord", at(1).alias("start"), at(4).alias("end"), *_box(box))


def loose_cues(texts: DataFrame, key: str, vtt: str = "vtt") -> DataFrame:
    """Line by line, any number of digits; the box is looked for on the next line only."""
    lines = F.split(vtt, "\n")
    paired = texts.select(key, F.posexplode(F.zip_with(lines, F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string"))), lambda a, b: F.struct(a.alias("head"), b.alias("box")))).alias("ord", "pair"))
    good = paired.where(F.col("pair.head").rlike(LOOSE) & F.col("pair.box").rlike(XYWH))
    part = lambda i: F.regexp_extract("pair.head", LOOSE, i).cast("double")
    at = lambda i: part(i) * 3600 + part(i + 1) * 60 + part(i + 2) + part(i + 3) / 1000
    return good.select(key, "ord", at(1).alias("start"), at(5).alias("end"), *_box(F.col("pair.box")))


def tile_times(cues: DataFrame) -> DataFrame:
    """Cues with their tile's timestamp, the middle; empty tiles go."""
    return cues.where("w > 0 and h > 0").withColumn("timestamp", (F.col("start") + F.col("end")) / 2)
