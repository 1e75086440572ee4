"""Phrase collocations, counted in a HAT-trie.

A task counts the phrases of one to three words of its texts in a trie over word ids: the first word leads to a hash
container of what may follow; a container of more than BURST entries bursts into a node of 16 containers, by four
bits of the second word's id, and so on.  Beyond a number of entries the task lets go of whole subtrees of first
words, the largest first, until half of the entries are left, and at the end of all.

What it lets go is written as sorted runs, one for each prefix partition: a partition holds the phrases whose first two words
hash to it (a single word goes by itself), so a frequent first word is spread by what follows it.  A
run is sorted by its words' hashes, which are the same in every task.  A partition's runs are merged in one task, which sums
up equal phrases by their words (hashes only place and order them) and gives those that reach the least count, besides how many words it saw.

Cuts, scores and the drop of parts of longer phrases are joins over the frequent phrases alone: a phrase that occurs
a times has parts that occur at least as often.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, shared_dir, table, written

#: Occurrences that a phrase needs, words of it at most, and the share (in percent) of a phrase's occurrences inside a longer one that drops it.
LEAST, SHARE, TOP = 10, 50, 2_000
#: Entries of a container before it bursts, entries of a task's trie before it spills, and words counted at a time.
BURST, ENTRIES, SLICE = 8_192, 800_000, 200_000
#: Different words of which a task keeps the ids; more start the ids anew.
WORDS = 1 << 19
BITS = 21
LOW = (1 << BITS) - 1
# What ends a piece.
ENDS = ".,;:!?\n\x0b\x0c\r"
_pieces = bytes(ord(".") if chr(b) in ENDS else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case (A-Z) words; b"." stands where a piece ends, as no word can be that."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_pieces).replace(b".", b" . ").split()


class WordIds(dict):
    """Word to its id in this task, from 1; b"." is 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words, self.hashes = [b"."], [0]

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


class HatTrie:
    """Counts by first word id and by the code of what follows it: second id and third id of 21 bits each, 0 for none."""

    def __init__(self, burst: int = BURST):
        self.burst, self.roots, self.size = burst, {}, {}
        self.entries = 0

    def add(self, first: int, rests: list[int], counts: list[int]) -> None:
        root = self.roots.get(first)
        if type(root) is dict and len(rests) == 1 and len(root) < self.burst:
            r, before = rests[0], len(root)
            root[r] = root.get(r, 0) + counts[0]
            new = len(root) - before
            self.size[first] += new
        elif root is None:
            self.roots[first] = dict(zip(rests, counts, strict=True))
            self.size[first] = new = len(rests)
        elif type(root) is dict:
            before, get = len(root), root.get
            for r, n in zip(rests, counts, strict=True):
                root[r] = get(r, 0) + n
            new = len(root) - before
            self.size[first] += new
            if len(root) > self.burst:
                self.roots[first] = self.split(root, BITS)
        else:
            new = 0
            for r, n in zip(rests, counts, strict=True):
                node, at = root, BITS
                while type(child := node[r >> at & 15]) is list:
                    node, at = child, at + 4
                if r in child:
                    child[r] += n
                else:
                    child[r] = n
                    new += 1
                    if len(child) > self.burst and at + 4 < 2 * BITS:
                        node[r >> at & 15] = self.split(child, at + 4)
            self.size[first] += new
        self.entries += new

    @staticmethod
    def split(container: dict[int, int], at: int) -> list[dict[int, int]]:
        """A node of 16 containers, by four bits of the code."""
        node: list[dict[int, int]] = [{} for _ in range(16)]
        for r, n in container.items():
            node[r >> at & 15][r] = n
        return node

    def take(self, first: int) -> Iterator[dict[int, int]]:
        """The containers of a subtree, which goes."""
        self.entries -= self.size.pop(first)
        todo = [self.roots.pop(first)]
        while todo:
            node = todo.pop()
            if type(node) is dict:
                yield node
            else:
                todo += node

    def largest(self, left: int) -> list[int]:
        """First words of the largest subtrees, which leave at most so many entries."""
        out, n = [], self.entries
        for first in sorted(self.roots, key=self.size.__getitem__, reverse=True):
            if n <= left:
                break
            out.append(first)
            n -= self.size[first]
        return out


class PhraseCounter:
    """A task's tries, a trie for each language, and the words that wait to be counted."""

    def __init__(self, parts: int, entries: int = ENTRIES, slice_words: int = SLICE, words: int = WORDS, burst: int = BURST):
        self.parts, self.most, self.slice, self.most_words, self.burst = parts, entries, slice_words, words, burst
        self.ids, self.tries, self.waiting = WordIds(), {}, {}
        self.n_waiting = 0

    def read(self, lang: str, text: str) -> Iterator[pd.DataFrame]:
        found = self.waiting.setdefault(lang, [])
        new = words_of(text)
        found += new
        found.append(b".")
        self.n_waiting += len(new) + 1
        if self.n_waiting >= self.slice:
            yield from self.count_waiting()

    def count_waiting(self) -> Iterator[pd.DataFrame]:
        for lang, words in self.waiting.items():
            for at in range(0, len(words), self.slice):
                before = min(at, 2)  # a slice sees the two words before it and counts what ends in it
                self.count(lang, words[at - before : at + self.slice], before)
                if sum(t.entries for t in self.tries.values()) > self.most:
                    yield from self.spill(self.most // 2)
                if len(self.ids) > self.most_words:
                    yield from self.spill(0)
                    self.ids = WordIds()
        self.waiting, self.n_waiting = {}, 0

    def count(self, lang: str, words: list[bytes], before: int) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        real = ids > 0
        two = real[:-1] & real[1:]
        three = two[:-1] & two[1:]
        seconds = (ids[:-1] << 2 * BITS) | (ids[1:] << BITS)
        found = [(ids << 2 * BITS)[before:][real[before:]]]
        for codes, good, skip in ((seconds, two, max(before - 1, 0)), (seconds[:-1] | ids[2:], three, max(before - 2, 0))):
            found.append(codes[skip:][good[skip:]])
        codes, counts = np.unique(np.concatenate(found), return_counts=True)
        if not len(codes):
            return
        first = codes >> 2 * BITS
        cuts = np.nonzero(np.concatenate(([True], first[1:] != first[:-1])))[0]
        trie = self.tries.setdefault(lang, HatTrie(self.burst))
        rests, counts = (codes & ((1 << 2 * BITS) - 1)).tolist(), counts.tolist()
        for f, i, j in zip(first[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rests)], strict=True):
            trie.add(f, rests[i:j], counts[i:j])

    def spill(self, left: int) -> Iterator[pd.DataFrame]:
        """Let whole subtrees go, as sorted runs."""
        share = left // max(1, len(self.tries))
        hashes = np.array(self.ids.hashes, dtype=np.uint64)
        for lang, trie in self.tries.items():
            gone = [(f, c) for f in trie.largest(share) for c in trie.take(f)]
            n = sum(len(c) for _, c in gone)
            if not n:
                continue
            codes = np.fromiter(chain.from_iterable(c for _, c in gone), dtype=np.int64, count=n)
            counts = np.fromiter(chain.from_iterable(c.values() for _, c in gone), dtype=np.int64, count=n)
            first = np.repeat(np.array([f for f, _ in gone], dtype=np.int64), [len(c) for _, c in gone])
            yield self.runs(lang, np.stack([first, codes >> BITS, codes & LOW]), counts, hashes)
        if not left:
            self.tries = {}

    def runs(self, lang: str, ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
        """A row for each prefix partition: its words, the places of each phrase's words among these (0: none), and counts."""
        part = prefix_part(hashes[ids[0]], hashes[ids[1]], self.parts)
        rank = np.empty(len(hashes), dtype=np.int64)
        rank[np.argsort(hashes)] = np.arange(len(hashes))
        order = np.argsort((rank[ids[0]] << 2 * BITS) | (rank[ids[1]] << BITS) | rank[ids[2]])
        order = order[np.argsort(part[order].astype(np.int32), kind="stable")]
        ids, counts, part = ids[:, order], counts[order], part[order]
        cuts = np.nonzero(np.concatenate(([True], part[1:] != part[:-1])))[0]
        rows, words = [], self.ids.words
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            own, place = np.unique(ids[:, i:j], return_inverse=True)
            if own[0]:  # 0 always stands for no word
                own, place = np.concatenate(([0], own)), place + 1
            rows.append((int(part[i]), lang, b" ".join(map(words.__getitem__, own.tolist())), place.astype("<u4").tobytes(), counts[i:j].astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["part", "lang", "words", "places", "counts"])


def prefix_part(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


class Numbers(dict):
    """Word to a number, from 0 in the order of coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class PartMerger:
    """Sums up the runs of a prefix partition and language."""

    def __init__(self, most: int = 4_000_000):
        self.ids = Numbers({b".": 0})
        self.held, self.n, self.most = [], 0, most

    def add(self, words: bytes, places: bytes, counts: bytes) -> None:
        own = np.fromiter(map(self.ids.__getitem__, words.split(b" ")), dtype=np.int64)
        counts = np.frombuffer(counts, dtype="<i8")
        self.held.append((own[np.frombuffer(places, dtype="<u4")].reshape(3, -1), counts))
        self.n += len(counts)
        if self.n > self.most:
            self.held = [self.summed()]
            self.n = len(self.held[0][1])
            self.most = max(self.most, 2 * self.n)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([x for x, _ in self.held], axis=1)
        counts = np.concatenate([n for _, n in self.held])
        pair = (ids[0] << 32) | ids[1]
        order = np.lexsort((ids[2], pair))
        ids, counts, pair = ids[:, order], counts[order], pair[order]
        first = np.nonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (ids[2, 1:] != ids[2, :-1]))))[0]
        return ids[:, first], np.add.reduceat(counts, first)

    def frequent(self, least: int) -> tuple[list[tuple[int, str, int]], int]:
        """(number of words, phrase, count) of phrases that occur often enough, and how many words there are."""
        ids, counts = self.summed()
        total = int(counts[ids[1] == 0].sum())
        often = counts >= least
        words, out = list(self.ids), []
        for three, n in zip(ids[:, often].T.tolist(), counts[often].tolist(), strict=True):
            named = [words[i] for i in three if i]
            out.append((len(named), b" ".join(named).decode("utf-8", "surrogatepass"), n))
        return out, total


def phrase_counts(docs: DataFrame, least: int = LEAST, parts: int | None = None, entries: int = ENTRIES) -> DataFrame:
    """lang, size, phrase, n of the phrases of one to three words that occur so often; size 0 holds how many words a prefix partition saw."""
    spark = docs.sparkSession
    small_batches(spark)
    shared_dir(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = PhraseCounter(parts, entries)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                yield from own.read(lang, text)
        yield from own.count_waiting()
        yield from own.spill(0)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, None
        for part, lang, *run in (r for b in batches for r in b.itertuples(index=False)):
            if (part, lang) != key:
                if own:
                    yield told(key[1], own)
                key, own = (part, lang), PartMerger()
            own.add(*run)
        if own:
            yield told(key[1], own)

    def told(lang: str, own: PartMerger) -> pd.DataFrame:
        found, total = own.frequent(least)
        return pd.DataFrame([(lang, *x) for x in [*found, (0, "", total)]], columns=["lang", "size", "phrase", "n"])

    runs = rows.mapInPandas(count, "part long, lang string, words binary, places binary, counts binary")
    laid = runs.repartition(parts, "part").sortWithinPartitions("part", "lang")
    return written(laid.mapInPandas(merge, "lang string, size int, phrase string, n long"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two and three words.

    A null text is empty, a null language "und"; null ids and repeated rows count as any; texts without words give
    nothing, and no rows no rows.  Scores are integers from exact arithmetic; ties end at the phrase's bytes, so every order is total.
    """
    return scored(phrase_counts(docs, least), share, top)


def scored(counts: DataFrame, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The best phrases by their own counts and those of their parts."""
    totals = counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    known = counts.where("size > 0").select("lang", "size", "phrase", "n")
    words = F.split("phrase", " ")
    join = lambda a, b: F.array_join(F.slice("w", F.lit(a), F.lit(b)), " ")
    named = known.where("size > 1").withColumn("w", words)
    two = F.array(F.struct(F.lit(1).alias("k"), join(1, 1).alias("first"), join(2, 1).alias("rest")))
    three = F.array(F.struct(F.lit(1).alias("k"), join(1, 1).alias("first"), join(2, 2).alias("rest")), F.struct(F.lit(2).alias("k"), join(1, 2).alias("first"), join(3, 1).alias("rest")))
    cuts = named.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.when(F.col("size") == 2, two).otherwise(three)).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumns({"over": F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), "under": wide("l") * wide("r")})
    both = both.withColumn("score", F.expr("cast(over div under as bigint)"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r")
    inside = named.where("size = 3").select("lang", "n", F.explode(F.array(join(1, 2), join(2, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    ranked = kept.selectExpr("*", "cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank").where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
