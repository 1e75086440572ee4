"""Scores of rows against a vocabulary of tags."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import cosine
from ..session import landed
from .clusters import units

#: Tags that go to every task at a time as an array column (some 4 MB of 1000 doubles each).
BLOCK = 500
#: Bytes of tags that go to every task at a time as a matrix, and rows multiplied with it at a time.
BYTES, SLICE = 32 << 20, 512


def _groups(columns: list, n: int) -> np.ndarray:
    """A number for each row, equal where all of the Arrow columns are."""
    codes = np.zeros(n, dtype=np.int64)
    for c in columns:
        own = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (own.max() + 1) + own, return_inverse=True)[1]
    return codes


def best_similarities(rows: DataFrame, tags: DataFrame, keys: list[str], vector: str = "embedding", limit: int = BYTES) -> DataFrame:
    """(keys..., tag_id, best): of each group of rows the highest cosine with each tag (tag_id, t).

    Rows are read once for each ``limit`` bytes of vocabulary (4,000 tags of 1000 numbers): a batch of them, sorted by group, is multiplied with the
    block in slices, and a slice gives its groups' maxima alone; no pairs are made.  Vectors of other lengths than a tag's, nulls and
    vectors with nulls, NaN or infinite numbers are similar to nothing (best is null for a group of only these); a zero vector has 0 with every tag. No rows or no tags give none.
    """
    spark = rows.sparkSession
    tags = landed(tags.select("tag_id", F.col("t").cast("array<double>").alias("t")), "tags")
    told = tags.agg(F.count("*").alias("n"), F.max(F.size("t")).alias("width")).head()
    n = max(1, -(-told.n * max(told.width or 1, 1) * 8 // limit))
    narrow = rows.select(*keys, F.col(vector).cast("array<double>").alias("__vector"))
    schema = StructType([*(narrow.schema[k] for k in keys), tags.schema["tag_id"], StructField("best", DoubleType())])

    def product(block):
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, by_width = block.value
            for batch in batches:
                codes = _groups([batch.column(i) for i in range(len(keys))], batch.num_rows)
                order = np.argsort(codes, kind="stable")
                for at in range(0, len(order) if len(ids) else 0, SLICE):
                    some = order[at : at + SLICE]
                    vectors = batch.column(len(keys)).take(pa.array(some))
                    widths = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
                    sims = np.full((len(some), len(ids)), np.nan)
                    for width, (places, unit) in by_width.items():
                        fit = np.nonzero(widths == width)[0]
                        flat = vectors.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), width)
                        whole = np.isfinite(flat).all(axis=1)
                        sims[np.ix_(fit[whole], places)] = units(list(flat[whole]), width) @ unit.T
                    first = np.nonzero(np.diff(codes[some], prepend=-1))[0]
                    most = np.fmax.reduceat(sims, first, axis=0).ravel()
                    named = pa.array(np.repeat(some[first], len(ids)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(named) for i in range(len(keys))), ids.take(pa.array(np.tile(np.arange(len(ids)), len(first)))), pa.array(most, mask=np.isnan(most))], names=schema.names)

        return best

    parts = []
    for b in range(n):
        some = tags.where(F.pmod(F.xxhash64("tag_id"), F.lit(n)) == b).toArrow()
        vectors = some["t"].to_pylist()
        by_width = {}
        for width in {len(v) for v in vectors if v is not None}:
            places = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)], dtype=int)
            by_width[width] = (places, units([vectors[i] for i in places], width))
        block = spark.sparkContext.broadcast((some["tag_id"].combine_chunks(), by_width))
        parts.append(narrow.mapInArrow(product(block), schema))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "tag_id").agg(F.max("best").alias("best"))


def best_tags(rows: DataFrame, tags: DataFrame, vector: str = "embedding", decimals: int = 9, block: int = BLOCK) -> DataFrame:
    """rows with ``best_tag`` (of highest cosine, rounded; the smallest tag_id on ties) and ``best_score``.

    A row meets each bounded block of the vocabulary as one array and keeps its best; rows and pairs aren't shuffled.
    """
    n = max(1, -(-tags.count() // block))
    found = rows
    for b in range(n):
        some = tags.where(F.pmod(F.xxhash64("tag_id"), F.lit(n)) == b).agg(F.collect_list(F.struct("tag_id", "t")).alias("__tags"))
        each = F.array_max(F.transform("__tags", lambda t: F.struct(F.round(cosine(F.col(vector), t["t"]), decimals).alias("s"), (-t["tag_id"]).alias("o"))))
        found = found.join(F.broadcast(some)).withColumn("__best", F.greatest(each, F.col("__best")) if b else each).drop("__tags")
    return found.withColumns({"best_tag": -F.col("__best.o"), "best_score": F.col("__best.s")}).drop("__best")
