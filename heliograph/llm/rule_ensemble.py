"""Quality by a sparse ensemble of rules.

1. Statistics of a text (shares of symbols, capitals, repeated words and the like) are measured once.
2. A random forest over the labelled rows' statistics proposes rules: every path from a tree's root to a node is a
   conjunction of bounds on statistics.
3. Lasso logistic regression over the rules' truth values keeps few of them, with weights.
4. The kept rules are compiled into one Spark column over the statistics: a score needs no model at run time.

Only labelled rows whose crc32(doc_id as text) mod 5 is not 0 are fitted on, at most MAX_TRAIN_DOCS of them.  The trees
and the regression are Spark's own; the forest's and the regression's input is a table of numbers of that many rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table, texts, written
from .quality import MEASURES, measure

#: Labelled rows that are fitted on, at most (those of smallest hash).
MAX_TRAIN_DOCS = 12_000
TREES, DEPTH, SEED = 20, 4, 7
#: Weight of the lasso's penalty, weights that count as none, and the rows that a rule must hold for and fail for.
PENALTY, TINY, SUPPORT = 0.002, 1e-4, 10
#: Score from which a document is predicted to be of quality.
THRESHOLD = 0.3

MORE = "n_twice long, n_odd_words long, n_digits long, n_chars long"
NAMES = [m.split()[0] for m in f"{MEASURES}, {MORE}".split(", ")]
LETTER = re.compile(r"[^\W\d_]")
#: Statistics by name: shares, and distinct words by the root of all words, so that they mean the same at every length.
STATISTICS = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "twice": "n_twice / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "distinct": "n_distinct / sqrt(greatest(n_words, 1))",
    "word_length": "word_chars / greatest(n_words, 1)",
    "odd_words": "n_odd_words / greatest(n_words, 1)",
    "digits": "n_digits / greatest(n_chars, 1)",
    "letters": "n_letters / greatest(n_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def measure_more(text: str) -> tuple[int, ...]:
    """Words equal to the word before, words without a letter, digits, characters."""
    words = text.split()
    kinds = Counter(words)
    return sum(a == b for a, b in zip(words, words[1:], strict=False)), sum(n for w, n in kinds.items() if not LETTER.search(w)), sum(map(text.count, "0123456789")), len(text)


def statistics(text: Column) -> Column:
    """A struct of the numbers that the statistics are made of; a null text is empty."""

    @F.pandas_udf(f"{MEASURES}, {MORE}")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*measure(t or ""), *measure_more(t or "")) for t in batch], columns=NAMES, dtype="int64")

    return measured(text)


def with_statistics(rows: DataFrame) -> DataFrame:
    """rows (any columns but ``m``) with the statistics beside them, for a column ``text`` that goes."""
    kept = [c for c in rows.columns if c != "text"]
    return rows.withColumn("m", statistics(F.col("text"))).select(*kept, "m.*").select(*kept, *(F.expr(e).alias(n) for n, e in STATISTICS.items()))


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (statistic, whether above, bound), sorted."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(n) > v if above else F.col(n) <= v for n, above, v in self.bounds))

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if above else '<='} {v!r}" for n, above, v in self.bounds)


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The score as a column over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)$")


def paths(tree: str, names: list[str]) -> Iterator[Rule]:
    """Every path of a tree, told by Spark's description of it, that has a bound."""
    held: list[tuple[int, tuple[str, bool, float]]] = []
    for line in tree.splitlines():
        if m := SPLIT.match(line):
            deep = len(m[1])
            held = [h for h in held if h[0] < deep]
            held.append((deep, (names[int(m[3])], m[4] == ">", float(m[5]))))
            yield tightened([b for _, b in held])


def tightened(bounds: list[tuple[str, bool, float]]) -> Rule:
    """Of several bounds of a statistic in a direction only the tightest."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, value in bounds:
        old = best.get((name, above))
        best[name, above] = value if old is None else max(old, value) if above else min(old, value)
    return Rule(tuple(sorted((n, a, v) for (n, a), v in best.items())))


def labelled(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Statistics and ``label`` of the rows to fit on.

    Labels without a document, null labels and null ids are left out; of several labels of a document the smallest counts.
    At most ``max_train_docs`` labels are broadcast to the documents, and at most as many rows are kept.
    """
    drawn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int") > 0).cast("int").alias("label")).where("doc_id is not null and label is not null")
    drawn = drawn.where(crc_fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    measured = with_statistics(texts(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")).distinct()
    return measured.orderBy(F.xxhash64("doc_id"), *measured.columns).limit(max_train_docs)


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> RuleModel:
    """Without labels of both kinds the model has no rules, and its bias is the share of label 1."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    sample = written(labelled(docs, labels, max_train_docs).coalesce(1), "quality-sample")  # one small file: the same rows in the same order
    there = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    good, bad = there.get(1, 0), there.get(0, 0)
    share = (good + 0.5) / (good + bad + 1)
    if not good or not bad:
        return RuleModel(math.log(share / (1 - share)), [])
    names = list(STATISTICS)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("label", "features")
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=SUPPORT, featureSubsetStrategy="0.5", maxBins=64, seed=SEED).fit(rows)
    found = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree.toDebugString, names)))
    truth = sample.select("label", F.array(*(r.column().cast("int") for r in found)).alias("t"))
    held = truth.select(F.posexplode("t").alias("i", "t")).groupBy("i").agg(F.sum("t").alias("n")).collect()
    sums = {r.i: r.n for r in held}
    found = [r for i, r in enumerate(found) if SUPPORT <= sums[i] <= good + bad - SUPPORT]
    if not found:
        return RuleModel(math.log(share / (1 - share)), [])
    marks = sample.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in found))).alias("features"))
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(marks)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), [(r, w) for r, w in zip(found, weights, strict=True) if abs(w) > TINY])


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of every row; null texts are empty, null ids (not held out nor in: null) and repeated rows stay."""
    rows = with_statistics(texts(docs)).withColumn("score", model.score())
    return rows.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *STATISTICS)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
