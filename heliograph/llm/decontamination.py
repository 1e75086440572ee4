"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. The test items' word 3-grams are looked up in every document.  Hits of one item that lie within
   an item's length of each other open a passage, with an item's length of words on either side.  Long passages are
   cut into overlapping windows; an alignment that reaches the threshold is short enough to lie in one, so none is lost.
2. Every passage goes on, however often its seeds stand in other documents or items: a cut at frequent seeds would
   lose copies that many documents quote with the same edit.  It is left out only if the words that it shares with the
   item, repeats counted, are too few for the threshold: an alignment matches no more words than that, so none is lost.
3. Smith-Waterman aligns the words of passage and item: +2 for a match, -1 for a mismatch or gap.
   The score is the best alignment's share of what the whole item would reach.

So a copy is found if one 3-gram of it is intact.  A benchmark of more than BLOCK_CHARS characters goes over
the documents in blocks of that size, after one scan that keeps the documents with a 3-gram of any item.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts, written

WORD = re.compile(r"\w+")
N = 3
MATCH, MISS, GAP = 2, -1, 1
THRESHOLD = 0.5
#: Characters of benchmark text that are broadcast at a time.
BLOCK_CHARS = 8_000_000
#: Hashes of 3-grams that are broadcast at a time (8 bytes each).
SEEDS = 8_000_000
#: Words whose hashes a worker remembers.
REMEMBER = 200_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class SeedIndex:
    """The 3-grams of a block of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words_of(t or "")) for i, t in items]
        self.vocabulary: dict[str, int] = {}
        for _, words in self.items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        where = defaultdict(list)
        self.size = np.int64(len(self.vocabulary) + 1)
        self.counts = [Counter(words) for _, words in self.items]
        for k, (_, words) in enumerate(self.items):
            codes = self.codes(np.array([self.vocabulary[w] for w in words], dtype=np.int64))
            for at, code in enumerate(codes.tolist()):
                where[code].append((k, at))
        self.sorted = np.array(sorted(where), dtype=np.int64)
        self.where = [where[c] for c in self.sorted.tolist()]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each 3-gram; -1 where a word isn't in the benchmark."""
        if len(ids) < N:
            return np.zeros(0, dtype=np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * self.size + b) * self.size + c, -1)

    def passages(self, text: str, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, list[str]]]:
        """(item's place, first word, words) of every passage with a seed that may reach the threshold."""
        words = words_of(text)
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        codes = self.codes(ids)
        spots = np.nonzero(codes >= 0)[0]
        if not len(spots) or not len(self.sorted):
            return
        at = np.searchsorted(self.sorted, codes[spots])
        good = self.sorted[np.minimum(at, len(self.sorted) - 1)] == codes[spots]
        hits = defaultdict(list)
        for spot, seed in zip(spots[good].tolist(), at[good].tolist(), strict=True):
            for item in {k for k, _ in self.where[seed]}:
                hits[item].append(spot)
        for item, found in hits.items():
            m = len(self.items[item][1])
            region = [found[0]]
            for hit in [*found[1:], None]:
                if hit is not None and hit - region[-1] <= m:
                    region.append(hit)
                    continue
                own = self.counts[item]
                for first, end in windows(region, m, len(words), threshold):
                    shared = (Counter(w for w in words[first:end] if w in own) & own).total()
                    if shared / m >= threshold:
                        yield item, first, words[first:end]
                region = [hit]


def longest(m: int, threshold: float) -> int:
    """Words that an alignment with an item of m words takes in the passage, at most, if it reaches the threshold.

    With k matches and d other words of the passage it has 2 k - d >= 2 m threshold at best, and k is at most m.
    """
    return max(N, math.ceil(m * (1 + MATCH * (1 - threshold)))) if threshold > 0 else 3 * m


def windows(region: list[int], m: int, n: int, threshold: float) -> Iterator[tuple[int, int]]:
    """First and end word of the windows over a region of seeds: every span of ``longest`` words with a seed lies in one of them."""
    first, end, step = max(0, region[0] - m), min(n, region[-1] + N + m), longest(m, threshold)
    if end - first <= 2 * step:
        yield first, end
        return
    for start in range(first, end - step, step):
        seed = bisect_left(region, start)
        if seed < len(region) and region[seed] < start + 2 * step:
            yield start, min(end, start + 2 * step)


def smith_waterman(passage: list[str], item: list[str]) -> tuple[int, int]:
    """The best local alignment's score and where it ends in the passage."""
    names = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p = np.fromiter((names.get(w, -1) for w in passage), dtype=np.int64, count=len(passage))
    ramp = np.arange(1, len(p) + 1) * GAP
    row = np.zeros(len(p) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        step = np.maximum(row[:-1] + np.where(p == names[w], MATCH, MISS), row[1:] - GAP)
        step = np.maximum(np.maximum.accumulate(np.maximum(step, 0) + ramp) - ramp, 0)  # gaps along the passage
        row[1:] = step
        if len(p) and (top := int(step.max())) > best:
            best, end = top, int(step.argmax()) + 1
    return best, end


def align(passage: list[str], item: list[str]) -> tuple[float, int, int]:
    """Score in [0, 1] and the aligned span of passage words."""
    if not item or not passage:
        return 0.0, 0, 0
    whole, inside = " " + " ".join(passage) + " ", " " + " ".join(item) + " "
    if (at := whole.find(inside)) >= 0:  # no alignment can be better
        first = whole.count(" ", 0, at + 1) - 1
        return 1.0, first, first + len(item)
    best, end = smith_waterman(passage, item)
    _, back = smith_waterman(passage[:end][::-1], item[::-1])
    return best / (MATCH * len(item)), end - back, end


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def gram_hashes(text: str, known: WordHashes) -> np.ndarray:
    """A 64-bit number for each 3-gram of words."""
    h = np.array([known[w] for w in words_of(text)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        return h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + (h[2:] ^ (h[2:] >> np.uint64(29))) if len(h) >= N else h[:0]


def holding(docs: DataFrame, items: DataFrame, most: int = SEEDS) -> DataFrame:
    """The documents with a 3-gram of any item, in one scan for each ``most`` different 3-grams."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"h": np.unique(np.concatenate([gram_hashes(t, known) for t in batch["text"]] or [np.zeros(0, dtype=np.uint64)])).astype(np.int64)})

    seeds = written(items.mapInPandas(grams, "h long").distinct(), "seeds")
    n = -(-seeds.count() // most) or 1
    kept = []
    for k in range(n):
        part = np.sort(seeds.where(F.pmod(F.xxhash64("h"), F.lit(n)) == k).toPandas()["h"].to_numpy().astype(np.uint64))
        shared = docs.sparkSession.sparkContext.broadcast(part)

        @F.pandas_udf("boolean")
        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known, own = WordHashes(), shared.value  # noqa: B023
            for batch in batches:
                out = []
                for text in batch:
                    h = gram_hashes(text, known)
                    out.append(bool(len(own) and (own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h).any()))
                yield pd.Series(out, dtype=bool)

        kept.append(docs.where(held("text")))
    return written(kept[0] if n == 1 else reduce(DataFrame.unionByName, kept).distinct(), "holding")


def _block(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    cached: dict[int, SeedIndex] = {}

    def index() -> SeedIndex:
        if 0 not in cached:
            cached[0] = SeedIndex(shared.value)
        return cached[0]

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index()
        for batch in batches:
            rows = [(doc, key, item, first, " ".join(passage)) for doc, key, text in zip(batch["doc_id"].astype("Int64"), batch["text_key"], batch["text"], strict=True) for item, first, passage in own.passages(text, threshold)]
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "item", "first", "passage"]).astype({"doc_id": "Int64"})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index()
        for batch in batches:
            rows = []
            for doc, key, item, first, passage in zip(batch["doc_id"].astype("Int64"), batch["text_key"], batch["item"], batch["first"], batch["passage"], strict=True):
                s, a, b = align(passage.split(" "), own.items[item][1])
                rows.append((doc, key, own.items[item][0], s, first + a, first + b))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "score", "first_word", "end_word"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    found = written(docs.mapInPandas(seek, "doc_id long, text_key long, item int, first long, passage string"), "passages")
    return found.repartition(F.xxhash64("doc_id", "text_key", "item", "first")).mapInPandas(score, "doc_id long, text_key long, item_id long, score double, first_word long, end_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), item_id, score, first_word, end_word of the best passage for each document and item that reach the threshold.

    Null texts are empty; an empty table or benchmark gives no rows.  Items of under three words have no seeds and match
    nothing; a repeated item id is several items of that id.  Rows equal in doc_id and text give one row for an item.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = -(-chars // block_chars) or 1
    if n > 1:
        items = written(items, "items")
        rows = holding(rows, items)
    found = []
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        found.append(_block(rows, [(r.item_id, r.text) for r in block], threshold))
    scored = reduce(DataFrame.unionByName, found).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("first_word", "end_word"), F.struct("score", -F.col("first_word")))
    return scored.groupBy("doc_id", "text_key", "item_id").agg(F.max("score").alias("score"), best.alias("span")).select("doc_id", "text_key", "item_id", "score", "span.first_word", "span.end_word")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
