"""Packing by non-negative least squares.

Each document's ids (and the end id) give full windows, which are sequences of their own, and a
tail shorter than a window.  The tails' length histogram has one entry a length, so it is bounded
by the window, not by the corpus.  Shallow combinations of lengths that fill a window exactly are
enumerated (one length some times over and at most two others, all of them lengths that are there); of these
every g-th is a column, so that at most COLUMNS are.  Non-negative least squares finds repeat counts whose
combined lengths come closest to the histogram; they are rounded, to 1 at least where they matter, and trimmed to what there is.
The lengths left are the next round's histogram, until at most LEFT of the tails are left or no combination is.
Those are packed greedily: windows are filled with the longest first, and what doesn't fit in whole is cut at the
window's end; the last incomplete window is cut in sequences that are powers of two and need no padding.

The plan thus says, for each length, which ranks go where.  It has at most three rows a column and round
at any corpus size (some ten thousand in all), and every tail finds its place by (length, rank).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts, written
from .token_ids import encoder, pack_vocabulary

WINDOW = 2048
#: Columns of a least squares problem, problems, and the share of tails that may be left to greedy packing.
COLUMNS, PROBLEMS, LEFT = 12_000, 12, 0.05
#: Repeat counts from which a combination is used at least once, if its lengths are still there.
LEAST_USE = 0.05


def combinations(present: np.ndarray, most: int = COLUMNS, turn: int = 0) -> tuple[np.ndarray, int]:
    """Rows (v, m, a, b) with m * v + a + b = window, 0 for none; every g-th of all of them, and g.

    ``present``: whether there are tails of each length below the window.
    """
    window = len(present)
    lengths = np.nonzero(present)[0].astype(np.int32)
    lengths = lengths[lengths > 0]
    others, usable = np.append(np.int32(0), lengths), np.append(present, False)
    usable[0] = True

    def filling(m: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths that can stand m times, and which (length, other) leave a third one that is there."""
        v = lengths[lengths * m <= window]
        b = window - m * v[:, None] - others[None, :]
        return v, (b >= others[None, :]) & usable[np.clip(b, 0, window)]

    deepest = window // int(lengths[0]) if len(lengths) else 0
    counts = [np.count_nonzero(filling(m)[1]) for m in range(1, deepest + 1)]
    g = max(1, -(-sum(counts) // most))
    found, before = [np.zeros((0, 4), dtype=np.int64)], 0
    for m, n in enumerate(counts, 1):  # only the g-th ones are made: all of them are some millions
        v, fills = filling(m)
        at = np.flatnonzero(fills)[(turn - before) % g :: g]
        i, a = at // len(others), others[at % len(others)].astype(np.int64)
        found.append(np.stack([v[i].astype(np.int64), np.full(len(at), m), a, window - m * v[i].astype(np.int64) - a], axis=1))
        before += n
    return np.concatenate(found), g


def nnls(columns: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2; accelerated projected gradient.

    A has a column for each combination, with how often it takes each length.
    """
    v, m, a, b = columns.T
    size = np.sqrt(m * m + (a > 0) + (b > 0))  # columns are scaled to one length, which evens the steps
    uses = [(v, m / size), (a, (a > 0) / size), (b, (b > 0) / size)]

    def apply(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(at, weights=n * x, minlength=len(histogram)) for at, n in uses)

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[at] * n for at, n in uses)

    probe = np.ones(len(columns))
    for _ in range(20):  # the largest eigenvalue of A'A
        probe = back(apply(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(apply(y) - histogram) / (norm * 1.01))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x / size


def plan(histogram: np.ndarray, window: int = WINDOW, columns: int = COLUMNS) -> tuple[pd.DataFrame, pd.DataFrame, int, int]:
    """Where tails go: combination rows, stream rows, the number of sequences that combinations take, and the stream's length.

    Combination rows: of ``len``, ranks from ``lo`` to below ``hi`` go, ``each`` to a sequence, to
    sequences from ``first`` on, the k-th at ``offset + k * len``.  Stream rows: of ``len``, ranks
    from ``lo`` on lie in the stream from ``at`` on.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros_like(left)
    rows, first, enough = [], 0, LEFT * left.sum()
    for turn in range(PROBLEMS):
        before = left.sum()
        if before <= enough:
            break
        found, g = combinations(left > 0, columns, turn)
        if not len(found):
            break
        x = nnls(found, left.astype(float))
        for c in np.argsort(-x, kind="stable").tolist():
            if x[c] < LEAST_USE:
                break
            v, m, a, b = found[c].tolist()
            need = Counter({v: m})
            need.update(n for n in (a, b) if n)
            times = min([max(1, int(x[c] + 0.5)), *(int(left[n]) // k for n, k in need.items())])
            if times <= 0:
                continue
            offset = 0
            for n, k in sorted(need.items(), reverse=True):
                rows.append((n, int(taken[n]), int(taken[n]) + times * k, k, first, offset))
                taken[n] += times * k
                left[n] -= times * k
                offset += n * k
            first += times
        if g == 1 and left.sum() == before:
            break
    stream, at = [], 0
    for v in range(window - 1, 0, -1):
        if left[v]:
            stream.append((v, int(taken[v]), at))
            at += int(left[v]) * v
    return pd.DataFrame(rows, columns=["len", "lo", "hi", "each", "first", "offset"]), pd.DataFrame(stream, columns=["len", "lo", "at"]), first, at


def tokenised(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """A written row for each input row: doc_id, n_ids, the crc32 of its full windows and of its tail, and the tail's ids.

    ids are counted in 32 bits.  A null or empty text is the end id alone; repeated rows stay.
    part and pos name the row; tail_rank counts equal tail lengths within the part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pack_vocabulary(vocabulary))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(shared.value), np.array([end_id], dtype="<u2").tobytes()
        ranks: Counter = Counter()
        for batch in batches:
            out = []
            for text in batch["text"]:
                short = enc.ids(text) + end
                ids = np.frombuffer(short, dtype="<u2").astype("<u4")
                full = len(ids) // window
                tail = len(ids) - full * window
                out.append((len(ids), [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(full)], tail, ranks[tail], zlib.crc32(ids[full * window :].tobytes()), short[2 * full * window :]))
                ranks[tail] += 1
            made = pd.DataFrame(out, columns=["n_ids", "full_crc", "tail_len", "tail_rank", "tail_crc", "tail_ids"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield made

    rows = texts(docs).mapInPandas(encode, "doc_id long, n_ids long, full_crc array<long>, tail_len long, tail_rank long, tail_crc long, tail_ids binary")
    return written(rows.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "tokenised")


def pieces(tokens: DataFrame, window: int = WINDOW, columns: int = COLUMNS) -> DataFrame:
    """doc_id, pos, doc_tokens, start, length, sequence_id, offset, crc (null where the tail is cut) of every piece."""
    spark = tokens.sparkSession
    rows = tokens.select("doc_id", "pos", "part", F.col("n_ids").alias("doc_tokens"), "full_crc", "tail_len", "tail_rank", "tail_crc")
    counts = rows.where("tail_len > 0").groupBy("tail_len", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tail_len").orderBy("part")) - F.col("n")
    histogram = np.zeros(window, dtype=np.int64)
    for r in counts.groupBy("tail_len").agg(F.sum("n").alias("n")).collect():  # a row for each length
        histogram[r.tail_len] = r.n
    combos, stream, n_combo, n_stream = plan(histogram, window, columns)
    combo_plan = F.broadcast(spark.createDataFrame(combos, "len long, lo long, hi long, each long, first long, offset long"))
    stream_plan = F.broadcast(spark.createDataFrame(stream, "len long, lo long, at long"))  # at most a row for each length

    # full windows: numbered by part, after the sequences of tails
    wholes = rows.withColumn("full", F.size("full_crc").cast("long"))
    per_part = wholes.groupBy("part").agg(F.sum("full").alias("n"))  # a row for each written partition, so one task numbers them
    part_first = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_first"))
    stream_full = n_stream // window
    rest = n_stream - stream_full * window
    powers = [1 << b for b in range(window.bit_length() - 1, -1, -1) if rest >> b & 1]
    base = n_combo + stream_full + len(powers)
    in_part = F.sum("full").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    wholes = wholes.where("full > 0").withColumn("row_first", F.coalesce(in_part, F.lit(0))).join(part_first, "part")
    full = wholes.select("doc_id", "pos", "doc_tokens", F.posexplode("full_crc").alias("k", "crc"), (F.lit(base) + F.col("part_first") + F.col("row_first")).alias("seq"))
    full = full.select("doc_id", "pos", "doc_tokens", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), (F.col("seq") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "crc")

    tails = rows.where("tail_len > 0").drop("full_crc").join(counts.select("tail_len", "part", before.alias("before")), ["tail_len", "part"])
    tails = tails.withColumn("rank", F.col("before") + F.col("tail_rank")).withColumn("tail_start", F.col("doc_tokens") - F.col("tail_len"))
    placed = tails.join(combo_plan, (F.col("tail_len") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    combined = placed.select("doc_id", "pos", "doc_tokens", F.col("tail_start").alias("start"), F.col("tail_len").alias("length"), (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("offset") + nth % F.col("each") * F.col("len")).alias("offset"), F.col("tail_crc").alias("crc"))

    # the stream: a tail lies at [at, at + tail_len); cut at window ends and, in the last window, at the powers
    ends, so_far = [], stream_full * window
    for p in powers[:-1]:
        so_far += p
        ends.append(so_far)
    laid = tails.join(stream_plan, (F.col("tail_len") == F.col("len")) & (F.col("rank") >= F.col("lo"))).withColumn("from", F.col("at") + (F.col("rank") - F.col("lo")) * F.col("len"))
    laid = laid.withColumn("to", F.col("from") + F.col("tail_len"))
    window_end = (F.floor(F.col("from") / window) + 1) * window
    cuts = F.array_sort(F.filter(F.array(window_end.cast("long"), *(F.lit(e).cast("long") for e in ends)), lambda e: (e > F.col("from")) & (e < F.col("to"))))
    edges = F.array_distinct(F.concat(F.array("from"), cuts, F.array("to")))
    cut = laid.withColumn("edges", edges).select("*", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("k", "a")).withColumn("b", F.element_at("edges", F.col("k") + 2))
    which, begin = F.floor(F.col("a") / window).cast("long"), (F.floor(F.col("a") / window) * window).cast("long")
    for i, e in enumerate(ends):
        which, begin = F.when(F.col("a") >= e, stream_full + i + 1).otherwise(which), F.when(F.col("a") >= e, e).otherwise(begin)
    streamed = cut.select("doc_id", "pos", "doc_tokens", (F.col("tail_start") + F.col("a") - F.col("from")).alias("start"), (F.col("b") - F.col("a")).alias("length"), (F.lit(n_combo) + which).alias("sequence_id"), (F.col("a") - begin).alias("offset"), F.when(F.size("edges") == 2, F.col("tail_crc")).alias("crc"))
    return full.unionByName(combined).unionByName(streamed)


def with_crc(found: DataFrame, tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with ids_crc32; only cut tails, two or so a sequence of the stream, look their ids up."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, dtype="<u2")[a : a + n].astype("<u4").tobytes()) for x, a, n in zip(ids, start, length, strict=True)], dtype="int64")

    known = found.where("crc is not null").withColumnRenamed("crc", "ids_crc32")
    tail = tokens.select("pos", "tail_ids", (F.col("n_ids") - F.col("tail_len")).alias("tail_start"))
    cut = found.where("crc is null").drop("crc").join(tail, "pos").withColumn("ids_crc32", crc("tail_ids", F.col("start") - F.col("tail_start"), F.col("length"))).drop("tail_ids", "tail_start")
    return known.unionByName(cut)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, columns: int = COLUMNS) -> DataFrame:
    """Every piece of every row: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty, and has the end id alone.  Rows with equal or null doc_id are packed each on its own.  No rows give no pieces.
    """
    tokens = tokenised(docs, vocabulary, window)
    return with_crc(pieces(tokens, window, columns), tokens, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
