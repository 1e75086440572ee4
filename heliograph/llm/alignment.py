"""Cross-tokenizer alignment by white-space anchors.

Every text is tokenised whole by a byte-level BPE (A, of " " + text) and a piece BPE with byte fallback (B, which puts the
space before the text itself).  Both token sequences spell the same bytes, so each token has an end in bytes.
An anchor is an end that both share and behind which both go on with a space-marked token (or a line feed); anchors behind a
word cut the two sequences into windows of token ids.  A window's groups and links depend on its ids alone, so a worker
remembers them by the pair of id tuples, and most windows of a corpus are looked up.

A group ends wherever tokens of A and B end together.  A link is a pair of an A token and a B token that end together;
no token is empty, so a group has one link.  How often an id pair is linked over the corpus is summed from each
document's distinct pairs, after a sum in each task.  These counts then go to the documents in blocks of
a fixed number of pairs: what a document sums up over its links is a sum over blocks as well, so there is no
limit on pairs, and no document's links are shuffled.

A text is tokenised in segments that neither tokenizer's tokens cross (tests hold the ids against whole texts); a worker
remembers their ids as well, and a segment whose tokens don't spell its bytes leaves its text without tokens.  So what
the segments' ends share is proved by bytes, and these are the anchors.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts, written
from .token_ids import WHITE, ordinary_encoding, pack_vocabulary, unpack_vocabulary

SPACE = "▁"
#: A segment goes on to the next space or line feed that follows a character that isn't white: A's pre-tokenizer cuts there, and no piece of B crosses it.
SEGMENTS = re.compile(f"[{WHITE}]*[^{WHITE}]*(?:(?![ \\n])[{WHITE}]+[^{WHITE}]*)*")
#: Segments, and windows, that a worker remembers; the longest of them.
REMEMBER, LONGEST = 300_000, 48
#: Characters of texts that are tokenised and aligned together.
CHUNK = 1_000_000
#: Id pairs whose counts are broadcast at a time (17 bytes each), and bits of a pair's number that hold B's id.
PAIRS, B_BITS = 2_000_000, 16


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending a and in ascending b of the values that both have."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(b, a)
    both = np.nonzero(b[np.minimum(at, len(b) - 1)] == a)[0]
    return both, at[both]


class Memory:
    """A bounded memory: what is met again stays longer than what was met once."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def find(self, keys: list) -> list:
        """The values; None where a key isn't known."""
        found = list(map(self.old.get, keys))
        if None in found:
            again = self.young.get
            for i, v in enumerate(found):
                if v is None and (v := again(keys[i])) is not None:
                    self.old[keys[i]] = found[i] = v
        return found

    def add(self, new: dict) -> None:
        if len(self.young) + len(new) > self.most // 2:
            self.young = {}
        self.young.update(new)
        if len(self.old) > self.most:
            self.old = {}


#: Stands for the ids of a segment that a tokenizer doesn't spell.
UNSPELLED = (b"", b"")


class Aligner:
    """Tokenises and aligns; ``a_bytes`` and ``b_bytes`` are the bytes of each id."""

    def __init__(self, encode_a, pieces, a_bytes: list[bytes], b_bytes: list[bytes], remember: int = REMEMBER):
        if max(len(a_bytes), len(b_bytes)) > 1 << B_BITS:
            raise ValueError("ids over 65535 don't fit 16 bits")
        self.encode_a, self.pieces, self.bytes = encode_a, pieces, (a_bytes, b_bytes)
        self.sizes = [np.array([len(t) for t in side], dtype=np.int64) for side in self.bytes]
        self.told = {mark: np.array([f"{i}{mark}" for i in range(max(map(len, self.bytes)))], dtype=object) for mark in ",|;"}
        self.segments, self.windows = Memory(remember), Memory(remember)

    def encode(self, segments: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A and of B, as 16-bit numbers, of segments; UNSPELLED where their bytes aren't the segment's."""
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        # A cuts behind a character that isn't white, so such segments are encoded in one go
        joined = [i for i, s in enumerate(segments) if not s[-1].isspace()]
        flat = array("H", self.encode_a("".join([segments[i] for i in joined])))
        ends = np.cumsum(self.sizes[0][np.frombuffer(flat, dtype="<u2")]) if flat else np.zeros(0, dtype=np.int64)
        asked = np.cumsum([len(raw[i]) for i in joined])
        cuts = np.searchsorted(ends, asked)
        if len(joined) and (cuts[-1] >= len(ends) or (ends[cuts] != asked).any()):
            raise ValueError("A's tokens cross segments: this vocabulary has another pre-tokenizer")
        of_a, at = {}, 0
        for i, c in zip(joined, (cuts + 1).tolist(), strict=True):
            of_a[i] = flat[at:c]
            at = c
        spaced = [s[0] == " " for s in segments]
        of_b = self.pieces.encode([s[1:] if sp else s for s, sp in zip(segments, spaced, strict=True)], num_threads=1)
        alone, out = self.pieces.piece_to_id(SPACE), []
        spell_a, spell_b = (own.__getitem__ for own in self.bytes)
        for i, (s, sp, b) in enumerate(zip(segments, spaced, of_b, strict=True)):
            if not sp:  # the space that B puts before a line feed is a piece of its own
                b = b[1:]
            elif len(s) == 1:
                b = [alone]
            a = of_a[i] if i in of_a else array("H", self.encode_a(s))
            good = b"".join(map(spell_a, a)) == raw[i] == b"".join(map(spell_b, b))
            out.append((a.tobytes(), array("H", b).tobytes()) if good else UNSPELLED)
        return out

    def tokens(self, texts: list[str]) -> list[list[tuple[bytes, bytes]] | None]:
        """The ids of each text by segments; None if it is empty or a tokenizer's bytes aren't those of " " + text."""
        cut = [[s for s in SEGMENTS.findall(" " + t) if s] if t else [] for t in texts]
        found = [self.segments.find(c) for c in cut]
        new = list(dict.fromkeys(s for c, f in zip(cut, found, strict=True) if None in f for s, ids in zip(c, f, strict=True) if ids is None))
        if new:
            fresh = dict(zip(new, self.encode(new), strict=True))
            found = [[fresh[s] if ids is None else ids for s, ids in zip(c, f, strict=True)] if None in f else f for c, f in zip(cut, found, strict=True)]
            self.segments.add({s: ids for s, ids in fresh.items() if len(s) <= LONGEST})
        return [f if f and UNSPELLED not in f else None for f in found]

    def align(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """Of each window, by its id tuples alone, the groups as text and the numbers (64 bits) of its linked pairs; both sides spell the same bytes."""
        ids = [np.frombuffer(b"".join(side), dtype="<u2") for side in zip(*windows, strict=True)]
        last = [np.cumsum([len(w[k]) // 2 for w in windows]) for k in (0, 1)]
        at = shared_ends(*(np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)))
        pairs = (ids[0][at[0]].astype("<i8") << B_BITS) | ids[1][at[1]]
        # where the tokens of A and B stand in the text of groups: those of a group side by side
        parts = np.empty(len(ids[0]) + len(ids[1]), dtype=object)
        for own, other, x, mark in ((0, 1, ids[0], "|"), (1, 0, ids[1], ";")):
            size = np.diff(at[own], prepend=-1)
            before = np.concatenate(([0], at[other][:-1] + 1)) if own == 0 else at[other] + 1
            words = self.told[","][x]
            words[at[own]] = self.told[mark][x[at[own]]]
            parts[np.arange(len(x)) + np.repeat(before, size)] = words
        parts, raw = parts.tolist(), pairs.tobytes()
        ends = np.cumsum([len(a) + len(b) for a, b in windows]) // 2
        groups = np.searchsorted(at[0], last[0] - 1) + 1
        out, i, g = [], 0, 0
        for j, h in zip(ends.tolist(), groups.tolist(), strict=True):
            out.append(("".join(parts[i:j])[:-1], raw[8 * g : 8 * h]))
            i, g = j, h
        return out

    def aligned(self, texts: list[str]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, the groups' digest, distinct pairs and their times of each text."""
        found = self.tokens(texts)
        known = [self.windows.find(f) if f else [] for f in found]
        new = list(dict.fromkeys(w for f, k in zip(found, known, strict=True) if None in k for w, v in zip(f, k, strict=True) if v is None))
        if new:
            fresh = dict(zip(new, self.align(new), strict=True))
            known = [[fresh[w] if v is None else v for w, v in zip(f, k, strict=True)] if None in k else k for f, k in zip(found, known, strict=True)]
            self.windows.add({w: v for w, v in fresh.items() if len(w[0]) <= LONGEST})
        out = []
        for f, k in zip(found, known, strict=True):
            if not f:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            pairs, times = np.unique(np.frombuffer(b"".join([v[1] for v in k]), dtype="<i8"), return_counts=True)
            digest = hashlib.sha256(";".join([v[0] for v in k]).encode()).hexdigest()
            n = int(times.sum())
            out.append((sum([len(w[0]) for w in f]) // 2, sum([len(w[1]) for w in f]) // 2, n, n, digest, pairs.astype("<i8").tobytes(), times.astype("<u4").tobytes()))
        return out


def piece_bytes(pieces) -> list[bytes]:
    """The bytes that each id of B stands for."""
    ids = range(pieces.get_piece_size())
    return [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]


_aligners: dict[str, Aligner] = {}


def aligner(packed: dict) -> Aligner:
    """This worker's aligner for two broadcast vocabularies."""
    import sentencepiece

    if packed["name"] not in _aligners:
        gc.disable()  # the memories hold no cycles, and each collection would walk all of them
        ranks = unpack_vocabulary(packed["a"])
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        pieces = sentencepiece.SentencePieceProcessor(model_proto=packed["b"])
        _aligners[packed["name"]] = Aligner(ordinary_encoding(ranks).encode_ordinary, pieces, a_bytes, piece_bytes(pieces))
    return _aligners[packed["name"]]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Counts and the groups' digest of every row, with its distinct linked pairs (ascending 64-bit numbers) and how often each is linked (32 bits)."""
    rows = texts(docs)
    with open(tokenizer_b, "rb") as file:
        model = file.read()
    vocabulary = pack_vocabulary(tokenizer_a)
    shared = docs.sparkSession.sparkContext.broadcast({"name": vocabulary["name"] + hashlib.sha256(model).hexdigest(), "a": vocabulary, "b": model})

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(shared.value)
        for batch in batches:
            out, some, chars = [], [], 0
            for text in batch["text"]:
                some.append(text)
                chars += len(text)
                if chars >= CHUNK:
                    out += own.aligned(some)
                    some, chars = [], 0
            out += own.aligned(some) if some else []
            made = pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield made

    return rows.mapInPandas(align, ALIGNED)


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and their summed times."""
    if not len(pairs):
        return pairs, times
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.nonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))[0]
    return pairs[first], np.add.reduceat(times, first)


def unpacked(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(batch["pairs"]), dtype="<i8"), np.frombuffer(b"".join(batch["times"]), dtype="<u4").astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (its links over the corpus) and best (no other pair of its B id has more links) from rows of ``aligned``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(summed(*unpacked(batch)))
            n += len(held[-1][0])
            if n > PAIRS:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                n = len(held[0][0])
                if 2 * n > PAIRS:  # distinct pairs alone are many: let them go
                    yield pd.DataFrame({"pair": held[0][0], "n": held[0][1]})
                    held, n = [], 0
        if held:
            pairs, times = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pd.DataFrame({"pair": pairs, "n": times})

    counts = written(rows.select("pairs", "times").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).coalesce(64), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # a row for each id of B at most
    return counts.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, at_a_time: int = PAIRS) -> DataFrame:
    """rows with n_best (links whose pair is a best one) and count_sum (sum of the links' counts)."""
    spark = rows.sparkSession
    n = -(-counts.count() // at_a_time) or 1
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(n):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(n)) == k).toPandas().sort_values("pair")
        shared = spark.sparkContext.broadcast(tuple(part[c].to_numpy() for c in ("pair", "n", "best")))

        @F.pandas_udf("n_best long, count_sum long")
        def look_up(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
            keys, ns, best = shared.value  # noqa: B023
            out = np.zeros((len(pairs), 2), dtype=np.int64)
            for i, (p, t) in enumerate(zip(pairs, times, strict=True)):
                at_p, at_k = shared_ends(np.frombuffer(p, dtype="<i8"), keys)
                t = np.frombuffer(t, dtype="<u4").astype(np.int64)[at_p]
                out[i] = t[best[at_k]].sum(), (t * ns[at_k]).sum()
            return pd.DataFrame(out, columns=["n_best", "count_sum"])

        got = rows.withColumn("got", look_up("pairs", "times"))
        rows = got.withColumns({c: F.col(c) + F.col(f"got.{c}") for c in ("n_best", "count_sum")}).drop("got")
        if k + 1 < n:
            rows = written(rows, "counted-links")
    return rows.drop("pairs", "times")


def align_tokenizers(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row.

    ``tokenizer_a``: a byte-level BPE file of ``tokenizers``; ``tokenizer_b``: a SentencePiece file.  Special tokens' strings are plain
    text.  Null and empty texts, and texts that a tokenizer doesn't spell byte for byte (U+2581), have zeros and an empty digest.
    Repeated rows count as often as they stand; null ids stay; no rows give no rows.
    """
    rows = written(aligned(docs, tokenizer_a, tokenizer_b), "aligned", "zstd")
    return with_counts(rows, pair_counts(rows))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
