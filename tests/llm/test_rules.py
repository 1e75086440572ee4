"""The sparse rule ensemble: paths, columns, held-out labels, odd rows."""

from __future__ import annotations

import math
import zlib

import pytest
from pyspark.sql import functions as F

from heliograph.llm import rule_ensemble
from heliograph.llm.rule_ensemble import Rule

TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=2
  If (feature 0 <= 0.5)
   If (feature 1 <= -1.5E-3)
    Predict: 0.0
   Else (feature 1 > -1.5E-3)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 2.0)
    Predict: 1.0
   Else (feature 0 > 2.0)
    Predict: 0.0
"""


def test_paths_of_a_tree():
    got = list(rule_ensemble.paths(TREE, ["a", "b"]))
    low, high = ("a", False, 0.5), ("a", True, 0.5)
    assert got == [Rule((low,)), Rule((low, ("b", False, -0.0015))), Rule((low, ("b", True, -0.0015))), Rule((high,)), Rule((("a", False, 2.0), high)), Rule((("a", True, 2.0),))]


def test_compiled_column_equals_the_rules(spark):
    model = rule_ensemble.RuleModel(-0.3, [(Rule((("a", False, 0.5), ("b", True, 2.0))), 1.25), (Rule((("b", False, 4.0),)), -2.0)])
    rows = [(a / 4, float(b)) for a in range(5) for b in range(6)]
    for r in spark.createDataFrame(rows, "a double, b double").withColumn("score", model.score()).collect():
        z = -0.3 + 1.25 * (r.a <= 0.5 and r.b > 2) - 2.0 * (r.b <= 4)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


@pytest.fixture(scope="module")
def small(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


@pytest.fixture(scope="module")
def model(small):
    return rule_ensemble.fit(*small)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_labels(small, model):
    docs, labels = small
    rows = rule_ensemble.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    bad, good = ([r for r in rows if r.quality == q] for q in (0, 1))
    assert len(bad) >= 10 and all(held_out(r.doc_id) for r in rows)
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad) and sum(r.predicted == 1 for r in good) >= 0.95 * len(good)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_and_other_columns_teach_nothing(small, model):
    docs, labels = small
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("?"), "n_chars": F.lit(0)})
    assert rule_ensemble.fit(other, turned) == model


def test_rules_are_few_and_hold_for_long_texts(small, model):
    docs, labels = small
    assert 0 < len(model.rules) <= 60
    good = [r.text for r in docs.join(labels, "doc_id").where("quality = 1 and toxic = 0").orderBy("doc_id").collect()]
    spark = docs.sparkSession
    joined = [(k, "\n".join(good[k::7][:n])) for k, n in enumerate((5, 10, 20, 40, 40, 40, 40))]
    rows = rule_ensemble.score_quality(spark.createDataFrame(joined, "doc_id long, text string"), model).collect()
    assert all(r.predicted == 1 for r in rows)


def test_odd_rows(spark, odd, nothing, model):
    rows = rule_ensemble.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [None, None]
    empty = {r.score for r in rows if r.doc_id in (1, 2, 3)}  # null, empty, blank
    assert len({r.score for r in rows if r.doc_id == 5}) == 1 and len(empty) <= 2
    assert rule_ensemble.score_quality(nothing, model).count() == 0
    none = spark.createDataFrame([(5, None), (None, 1)], "doc_id long, quality int")
    alone = rule_ensemble.fit(odd, none)
    assert alone.rules == [] and alone.bias == 0.0
    assert rule_ensemble.fit(nothing, none).rules == []
    one_kind = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    assert {r.predicted for r in rule_ensemble.score_quality(odd, rule_ensemble.fit(odd, one_kind)).collect()} == {1}
