"""Token counts without the tokens: count-only Viterbi over a unigram vocabulary.

Aho-Corasick lists every vocabulary piece that ends at each position; dynamic programming
carries the best score and that path's piece count.  Ties follow the Unigram model of
``tokenizers``: scores add up as doubles, a later candidate must be strictly better, and
candidates for one end come longest piece first.  A character that no single piece matches
costs the lowest score less 10 and counts its UTF-8 bytes (byte fallback).

No best path crosses a place that no vocabulary piece crosses, so a text is cut before each
run of spaces and around line feeds, and equal segments are counted once a worker.

The vocabulary and its scores are read from a SentencePiece file (a path, never copied).
That file's merges are not used: its pieces and scores are taken as a unigram model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

SPACE = "▁"
#: Segments remembered in a worker before it starts afresh.
REMEMBER = 500_000


def read_pieces(path: str) -> tuple[list[tuple[str, float]], float]:
    """The ordinary pieces with their scores, and the lowest score of all pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    ordinary = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return ordinary, min(model.get_score(i) for i in ids)


class UnigramCounter:
    """Counts the pieces of the best path of a text."""

    def __init__(self, pieces: list[tuple[str, float]], lowest: float, remember: int = REMEMBER):
        import ahocorasick

        self.unknown = lowest - 10.0
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        crossed = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        with_feed = any("\n" in p for p, _ in pieces)
        self.segments = re.compile(r"[\s\S]+" if crossed or with_feed else " +[^ \n]*|[^ \n]+|\n")
        self.known: dict[str, int] = {}
        self.remember = remember

    def best(self, segment: str) -> tuple[float, int]:
        """Score and piece count of the best path through a normalised segment."""
        n = len(segment)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.matches.iter(segment):
            ends[end + 1].append(found)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, single = float("-inf"), 0, False
            for length, gain in ends[end]:  # longest first
                single = single or length == 1
                if (s := score[end - length] + gain) > top:
                    top, pieces = s, count[end - length] + 1
            if not single and (s := score[end - 1] + self.unknown) > top:
                top, pieces = s, count[end - 1] + len(segment[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = top, pieces
        return score[n], count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        if len(known) > self.remember:
            known.clear()
        for segment in self.segments.findall(" " + text.replace(SPACE, " ")):
            n = known.get(segment)
            if n is None:
                n = self.best(segment.replace(" ", SPACE))[1]
                if len(segment) <= 64:
                    known[segment] = n
            total += n
        return total


_counters: dict[int, UnigramCounter] = {}


def token_count(text: Column, spark: SparkSession, vocabulary: str) -> Column:
    """Number of unigram tokens of each text (long).

    null and empty texts count 0.  ``vocabulary``: path of a SentencePiece file, read on the
    driver; its pieces (a fixed table, well under 1 MB) are broadcast.
    """
    shared = spark.sparkContext.broadcast(read_pieces(vocabulary))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash((tuple(shared.value[0][-50:]), len(shared.value[0]), shared.value[1]))
        if key not in _counters:
            _counters[key] = UnigramCounter(*shared.value)
        counter = _counters[key]
        for batch in batches:
            yield pd.Series([counter.count(t) if t is not None else 0 for t in batch], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, n_chars of every row; null texts count 0, repeated rows stay repeated, no rows give no rows."""
    rows = texts(docs)
    return rows.select("doc_id", token_count(F.col("text"), docs.sparkSession, vocabulary).alias("n_tokens"), F.length("text").cast("long").alias("n_chars"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
