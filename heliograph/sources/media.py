"""Media files and model calls behind typed plug-ins.

A plug-in is a function from bytes (or a text) to rows; the engine owns the schema on both sides.
No weights or codecs are shipped: without a plug-in these operators raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "frame_index int, timestamp double, image binary, decoder string"
DETECTION = "ord int, confidence double, bbox struct<x_min:int,y_min:int,x_max:int,y_max:int>, yaw double, pitch double, roll double, occ_pred int, occ_prob double, sharpness double, embedding array<double>"


class NoModel(RuntimeError):
    """A model's or decoder's plug-in isn't configured."""


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def images_from(rows: DataFrame, path_images: DataFrame | None = None) -> DataFrame:
    """``image`` from base64, or from files by path."""
    decoded = rows.withColumn("image", F.unbase64("base64"))
    if path_images is None:
        return decoded
    found = path_images.select("path", F.col("content").alias("__file"))
    return decoded.join(found, "path", "left").withColumn("image", F.coalesce("image", "__file")).drop("__file")


def decode_frames(videos: DataFrame, decoders: list[tuple[str, Callable[[bytes, float], bytes | None]]]) -> DataFrame:
    """Rows (key, frame_index, timestamp, content) to frames: the first decoder in the chain that gives an image counts."""
    if not decoders:
        raise NoModel("no video decoder is configured")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [next(((image, name) for name, decode in decoders if (image := decode(c, t)) is not None), (None, None)) for c, t in zip(batch["content"], batch["timestamp"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "frame_index": batch["frame_index"], "timestamp": batch["timestamp"], "image": [g[0] for g in got], "decoder": [g[1] for g in got]})

    return videos.select("key", "frame_index", "timestamp", "content").mapInPandas(run, "key string, " + FRAME).where("image is not null")


def detect_faces(frames: DataFrame, detector: Callable[[bytes], list[dict]] | None) -> DataFrame:
    """Frames to detections, a row each, in the detector's order."""
    if detector is None:
        raise NoModel("no face detector is configured")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("ord", "confidence", "bbox", "yaw", "pitch", "roll", "occ_pred", "occ_prob", "sharpness", "embedding")]
        for batch in batches:
            rows = [(key, i, n, *(d.get(c) for c in names[1:])) for key, i, image in zip(batch["key"], batch["frame_index"], batch["image"], strict=True) for n, d in enumerate(detector(image))]
            yield pd.DataFrame(rows, columns=["key", "frame_index", *names])

    return frames.mapInPandas(run, "key string, frame_index int, " + DETECTION)


def text_model(prompt: Column, generate: Callable[[list[str]], list[str]] | None, retries: int = 3, refused: Callable[[str], bool] = lambda s: not s.strip()) -> Column:
    """Texts for prompts, a batch at a time; refused ones are asked again, '' when all tries fail."""
    if generate is None:
        raise NoModel("no text model is configured")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = [""] * len(batch)
            todo = list(range(len(batch)))
            for _ in range(retries):
                for i, text in zip(todo, generate([batch.iloc[i] for i in todo]), strict=True):
                    out[i] = text
                todo = [i for i in todo if refused(out[i])]
                if not todo:
                    break
            for i in todo:
                out[i] = ""
            yield pd.Series(out)

    return run(prompt)


def text_vectors(rows: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]] | None, length: int, target: str = "embedding") -> DataFrame:
    """rows with the vectors of their texts; each distinct text is encoded once, in batches, and joined back.

    A null text has a null vector. A vector of another length than ``length``, or another number of vectors than of texts, raises.
    """
    if encode is None:
        raise NoModel("no text encoder is configured")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[float(x) for x in v] for v in encode(list(batch["__text"]))]
            if len(found) != len(batch) or any(len(v) != length for v in found):
                raise ValueError(f"the encoder gave {len(found)} vectors of lengths {sorted({len(v) for v in found})} for {len(batch)} texts, not of {length}")
            yield pd.DataFrame({"__text": batch["__text"], "__vector": found})

    encoded = rows.select(F.col(text).alias("__text")).where("__text is not null").distinct().mapInPandas(run, "__text string, __vector array<double>")
    return rows.join(encoded, F.col(text) == F.col("__text"), "left").withColumn(target, F.col("__vector")).drop("__text", "__vector")


def enhance_images(rows: DataFrame, image: str, enhance: Callable[[list[bytes], list[str | None]], list[bytes | None]] | None, prompt: Column | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """rows whose image is the enhanced one, with ``enhanced``: whether the model gave one; else the source image stays.

    The model takes images and their prompts (null where there are none), ``most_bytes`` of images in a call unless one alone is larger. Null images aren't asked for.
    """
    if enhance is None:
        raise NoModel("no image model is configured")

    @F.pandas_udf("binary")
    def run(images: pd.Series, prompts: pd.Series) -> pd.Series:
        out: list[bytes | None] = [None] * len(images)
        asked = [i for i, b in enumerate(images) if b is not None]
        while asked:
            size = np.cumsum([len(images.iloc[i]) for i in asked])
            now, asked = asked[: (n := max(1, int(np.searchsorted(size, most_bytes, side="right"))))], asked[n:]
            for i, b in zip(now, enhance([images.iloc[i] for i in now], [prompts.iloc[i] for i in now]), strict=True):
                out[i] = b or None
        return pd.Series(out, dtype=object)

    made = run(F.col(image), F.lit(None).cast("string") if prompt is None else prompt)
    return rows.withColumn("__made", made).withColumns({image: F.coalesce("__made", image), "enhanced": F.col("__made").isNotNull()}).drop("__made")


def score_model(image: Column, score: Callable[[list[bytes]], list[float]] | None, low: float = 0.0, high: float = 1.0) -> Column:
    """Scores of images, clipped."""
    if score is None:
        raise NoModel("no scoring model is configured")

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(score(list(batch)), dtype=float).clip(low, high)

    return run(image)


def needs_rotation(orientation: Column) -> Column:
    """Whether an image's EXIF orientation tag (274) asks for a rewrite."""
    return F.coalesce(orientation != 1, F.lit(False))


def frame_cache_key(path: Column, timestamp: Column, fmt: Column, quality: Column, enhance: Column, model: Column, fidelity: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, timestamp.cast("string"), fmt, quality.cast("string"), enhance.cast("string"), model, fidelity.cast("string")), 256)


def missing_frames(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Requested frames that no cached file answers."""
    return wanted.join(cached.select("frame_key"), "frame_key", "left_anti")
