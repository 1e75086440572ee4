"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence s with a word that has a weight has probability p(s) =
sigmoid(bias + sum of its words' weights); the document's score is the noisy-or 1 - prod(1 - p(s)) over these.
Only document labels train it, and the trained sentence scores then locate the offending sentences.

Sentences without a weighted word say nothing, and those under FLOOR are taken as clean.  Of the evidence -log(1 - p(s))
of sentences under one half, what so many clean sentences bring by themselves is taken off first: ALLOWED times
their mean in clean training rows, and SPREADS of its standard deviations.  So many clean sentences don't add up to a toxic text, however long it
is.  Likelier sentences count in full, and a text scores at least as its likeliest sentence; one without
weighted words scores sigmoid(bias).

A word's weight is the sum over its features: the whole word and its prefixes of 3 to 8 letters,
so that inflected forms of a stem share what is learnt.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_fold, small_batches, table, texts, trimmed, written

#: Labelled rows that the classifier is fitted on, at most (those of smallest hash).
MAX_TRAIN_DOCS = 12_000
#: Characters of these rows, at most: later rows (by hash) are left out.  What goes to the driver is less than that.
MAX_TRAIN_CHARS = 100_000_000
#: Probability under which a sentence is taken as clean, and how much a clean training row weighs against a toxic one.
FLOOR, CLEAN_WEIGHT = 0.05, 3.0
#: What clean sentences may bring: so many times the mean in clean training rows (which the model was fitted on), and so many standard deviations.
ALLOWED, SPREADS = 3.0, 3.0
#: Features kept from the training rows, at most.
MAX_FEATURES = 400
#: Share of the toxic training rows that a feature stands in at least (and 3 rows), and its least log odds.
LEAST_SHARE, LEAST_ODDS = 0.015, 1.5
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
REMEMBER = 200_000


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in range(3, 9) if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences that hold a word; code points, end exclusive."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(m.group())]


@dataclass
class SentenceModel:
    bias: float
    weights: dict[str, float]
    #: Mean and standard deviation of the evidence of a clean row's sentence, where it is under one half.
    usual: float = 0.0
    spread: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        #: Every feature of a word starts as the word does, so other openings weigh nothing.
        self.openings = {f.lstrip("^")[:3] for f in self.weights}

    def word(self, word: str) -> float:
        if word[:3] not in self.openings:
            return 0.0
        got = self.known.get(word)
        if got is None:
            if len(self.known) > REMEMBER:
                self.known.clear()
            got = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def sentence_logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, low = sentences(text), lowered(text)
        return spans, np.array([self.bias + sum(map(self.word, WORD.findall(low, a, b))) for a, b in spans])

    def judge(self, text: str, threshold: float = 0.5) -> tuple[float, list[dict]]:
        """The document's score, and the sentences at or over the threshold."""
        low, openings = lowered(text), self.openings
        p, n = np.zeros(0), 0
        if any(self.word(w) for w in WORD.findall(low) if w[:3] in openings):
            spans, z = self.sentence_logits(text)
            told, n = z > self.bias, len(z)
            spans, p = [s for s, t in zip(spans, told.tolist(), strict=True) if t], 1 / (1 + np.exp(-z[told]))
        if not len(p):
            return 1 / (1 + math.exp(-self.bias)), []
        found = [{"start": a, "end": b, "score": float(x)} for (a, b), x in zip(spans, p, strict=True) if x >= threshold]
        brought = -np.log1p(-np.minimum(p, 1 - 1e-15))
        weak = brought[(p >= FLOOR) & (p < 0.5)].sum() - ALLOWED * self.usual * n - SPREADS * self.spread * math.sqrt(n)
        return float(-np.expm1(-max(brought[p >= 0.5].sum() + max(weak, 0.0), brought.max()))), found

    def score(self, text: str) -> float:
        return self.judge(text)[0]

    def offending(self, text: str, threshold: float = 0.5) -> list[dict]:
        return self.judge(text, threshold)[1]


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tally(sample: DataFrame, max_features: int = MAX_FEATURES) -> tuple[dict[str, int], int, int]:
    """The features that speak most for label 1 with their numbers, and how many rows have label 1 and 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
            for toxic, counts in seen.items():
                if not counts:
                    continue
                yield pd.DataFrame({"feature": list(counts), "pos": [n * toxic for n in counts.values()], "neg": [n * (1 - toxic) for n in counts.values()]})

    there = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = there.get(1, 0), there.get(0, 0)
    odds = F.log((F.col("pos") + 0.3) / (pos + 0.6)) - F.log((F.col("neg") + 0.3) / (neg + 0.6))
    counts = sample.select("text", "toxic").mapInPandas(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = counts.where(F.col("pos") >= max(3, math.ceil(LEAST_SHARE * pos))).withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "feature").limit(max_features)
    return {r.feature: i for i, r in enumerate(best.select("feature").collect())}, pos, neg


def encode(sample: DataFrame, chosen: dict[str, int]) -> list:
    """Of each row its label, its number of sentences, and the chosen features by sentence."""
    shared = sample.sparkSession.sparkContext.broadcast(chosen)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for batch in batches:
            rows = []
            for doc_id, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                low = text.lower()
                spans = sentences(low) or [(0, 0)]
                hits = [(i, at[f]) for i, (a, b) in enumerate(spans) for f in sorted({f for w in WORD.findall(low, a, b) for f in features(w)}) if f in at]
                rows.append((doc_id, toxic, len(spans), [i for i, _ in hits], [f for _, f in hits]))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "n", "sentence", "feature"])

    return sample.mapInPandas(bags, "doc_id long, toxic int, n int, sentence array<int>, feature array<int>").collect()


def train(rows: list, chosen: dict[str, int], rounds: int = 250, ridge: float = 1e-4) -> SentenceModel:
    """Gradient ascent on the noisy-or likelihood over sentences with a chosen feature; weights stay at or above 0."""
    if not chosen:
        share = sum(r.toxic for r in rows) / len(rows)
        return SentenceModel(math.log(share / (1 - share)), {})
    rows = sorted(rows, key=lambda r: (r.doc_id, r.toxic, r.n))
    doc = np.repeat(np.arange(len(rows)), [len(r.feature) for r in rows])
    col = np.concatenate([np.array(r.feature, dtype=np.int64) for r in rows])
    place = np.stack([doc, np.concatenate([np.array(r.sentence, dtype=np.int64) for r in rows])], axis=1)
    bags, sent = np.unique(place, axis=0, return_inverse=True)
    bag, n = bags[:, 0], len(bags)
    y = np.array([r.toxic for r in rows], dtype=float)
    weigh = np.where(y > 0, 1.0, CLEAN_WEIGHT)
    w, bias = np.zeros(len(chosen)), -3.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sent, weights=w[col], minlength=n)
        none = np.exp(-np.bincount(bag, weights=np.logaddexp(0.0, z), minlength=len(rows)))
        # d likelihood / d z(s): for label 1 p(s) none / (1 - none), for label 0 -p(s)
        up = weigh * np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        slope = up[bag] / (1 + np.exp(-z))
        g = np.append(np.bincount(col, weights=slope[sent], minlength=len(chosen)) / len(rows) - ridge * w, slope.sum() / len(rows))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(w + move[:-1], 0.0), bias + move[-1]
    return SentenceModel(float(bias), {f: float(w[i]) for f, i in chosen.items() if w[i] > 1e-3}, *usual_evidence(rows, bag, bias + np.bincount(sent, weights=w[col], minlength=n)))


def usual_evidence(rows: list, bag: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Mean and standard deviation of the evidence of clean rows' sentences between FLOOR and one half, with one more sentence of one half."""
    clean = np.array([not r.toxic for r in rows])
    p = 1 / (1 + np.exp(-z[clean[bag]]))
    brought = np.append(-np.log1p(-p[(p >= FLOOR) & (p < 0.5)]), math.log(2))
    n = sum(r.n for r in rows if not r.toxic) + 1
    mean = float(brought.sum()) / n
    return mean, math.sqrt(max(float((brought**2).sum()) / n - mean * mean, 0.0))


def bounded(sample: DataFrame, max_docs: int, max_chars: int) -> DataFrame:
    """The rows of smallest hash, at most so many and of so many characters; only keys and lengths are ordered."""
    keyed = sample.withColumn("key", F.xxhash64("text"))
    order = (F.xxhash64("doc_id"), "doc_id", "key")
    first = keyed.select("doc_id", "key", F.length("text").cast("long").alias("chars")).orderBy(*order).limit(max_docs)
    drawn = first.withColumn("sum", F.sum("chars").over(Window.orderBy(*order))).where(F.col("sum") <= max_chars).select("doc_id", "key")
    return keyed.join(F.broadcast(drawn), ["doc_id", "key"]).drop("key")


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_train_chars: int = MAX_TRAIN_CHARS) -> SentenceModel:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    At most ``max_train_docs`` labels, those of smallest hash, are broadcast to the documents
    (a bounded table), and at most as many rows and ``max_train_chars`` characters are fitted on.  Labels without a document, null labels and null ids are left out; of
    several labels for a document the largest counts.  Without labels of both kinds the model
    has no words, and its bias is the share of toxic labels.
    """
    drawn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    drawn = drawn.where(crc_fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    sample = written(texts(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").distinct(), "toxicity-labelled")
    sample = written(bounded(sample, max_train_docs, max_train_chars), "toxicity-sample")
    chosen, pos, neg = tally(sample)
    if not pos or not neg:
        share = (pos + 0.5) / (pos + neg + 1)
        return SentenceModel(math.log(share / (1 - share)), {})
    return train(encode(sample, chosen), chosen)


def score_documents(docs: DataFrame, model: SentenceModel, locate: bool = False) -> DataFrame:
    """row (a struct of the input's columns), score and, if asked for, offending (array of start, end, score).

    A null text is empty and scores sigmoid(bias); null ids and repeated rows stay, no rows give no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.usual, model.spread))
    kind = "score double, offending array<struct<start:long,end:long,score:double>>"

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = SentenceModel(*shared.value)
        for batch in trimmed(batches):
            got = [own.judge(t or "") for t in batch]
            yield pd.DataFrame({"score": pd.Series([g[0] for g in got], dtype=float), "offending": pd.Series([g[1] if locate else [] for g in got], dtype=object)})

    return docs.select(F.struct("*").alias("row"), scored(F.col("text").cast("string")).alias("toxicity")).select("row", "toxicity.score", "toxicity.offending")


def toxicity(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences' spans of every row.

    Null and empty texts score as texts without weighted words.  Repeated rows get equal scores.
    Without labels of both kinds every text gets the share of toxic labels.
    """
    rows = score_documents(texts(docs), fit(docs, labels, max_train_docs), locate=True)
    return rows.select("row.doc_id", (crc_fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))
