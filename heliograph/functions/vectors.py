"""Vector arithmetic on array columns; sums run in double precision, left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0.0 if either vector has no length."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def l2_normalise(a: Column) -> Column:
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def softmax2(a: Column, b: Column) -> Column:
    """struct(label, probability) of two logits; the first wins ties."""
    top = F.greatest(a, b)
    ea, eb = F.exp(a - top), F.exp(b - top)
    return F.struct((b > a).cast("int").alias("label"), (F.greatest(ea, eb) / (ea + eb)).alias("probability"))


def scene_tag_score(scene_cosine: Column, best_frame_cosine: Column, gate: float, log_temperature: float) -> Column:
    """Sigmoid of the gated mix of scene and best-frame similarity."""
    g = F.lit(1.0) / (F.exp(F.lit(-gate)) + 1.0)
    t = F.exp(F.least(F.lit(log_temperature), F.lit(2.65)))
    mixed = g * scene_cosine * t + (F.lit(1.0) - g) * best_frame_cosine * t
    return F.lit(1.0) / (F.exp(-mixed) + 1.0)


def with_mean_bias(vector: Column, biases: Column) -> Column:
    """The vector plus the element-wise mean of the bias vectors, normalised; without biases it is only normalised."""
    n = F.size(biases)
    total = F.aggregate(biases, F.transform(vector, lambda x: x * 0.0), lambda s, b: F.zip_with(s, b, lambda x, y: x + y))
    return l2_normalise(F.when(n > 0, F.zip_with(vector, total, lambda x, y: x + y / n)).otherwise(vector))
