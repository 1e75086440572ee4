"""Operators over hot keys, open ends, vocabularies, indexes and streams against plain loops."""

from __future__ import annotations

import os
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from heliograph.functions.vectors import cosine
from heliograph.operators import clusters, resources, scores, spans
from heliograph.operators.ordered import trailing
from heliograph.sources import media
from heliograph.streaming import jobs as streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("samples,block", [(1, 5), (7, 7), (7, 3), (20, 64), (300, 10)])
def test_trailing_means_of_a_hot_gauge(spark, samples, block):
    rng = random.Random(samples)
    rows = [(None if i % 50 == 0 else "hot" if i % 10 else "cold", i, None if rng.random() < 0.1 else float(rng.randrange(1000))) for i in range(600)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "gauge string, at long, x double").repartition(5)
    got = {r.at: r.m for r in trailing(frame, ["gauge"], ["at"], samples, {"m": "x"}, block).collect()}
    want, seen = {}, {}
    for g, at, x in sorted(rows, key=lambda r: r[1]):
        last = [v for v in (seen.setdefault(g, []).append(x) or seen[g][-samples:]) if v is not None]
        want[at] = sum(last) / len(last) if last else None
    assert got == want


def test_hot_gauge_in_many_tasks(spark):
    frame = spark.range(4000).select(F.lit("g").alias("k"), F.col("id").alias("at"), (F.col("id") % 97).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = trailing(frame, ["k"], ["at"], 10, {"m": "x"}, 100).groupBy(F.spark_partition_id().alias("p")).agg(F.count("m").alias("n")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r.n for r in spread) < 2500
    want = frame.withColumn("m", F.avg("x").over(Window.partitionBy("k").orderBy("at").rowsBetween(-719, 0))).orderBy("at").collect()
    assert [r.avg_x for r in resources.rolling(frame, ["k"], ["at"], ["x"], decimals=None).orderBy("at").collect()] == [r.m for r in want]
    assert trailing(frame.limit(0), ["k"], ["at"], 10, {"m": "x"}).count() == 0
    told = frame.select(F.when(F.col("at") >= 0, "g").alias("k"), "at", "x", F.lit(1).alias("total"))
    assert "WindowGroupLimit" in plan_of(resources.latest_averages(told, ["k"], ["at"], ["x"], ["total"]))


@pytest.mark.parametrize("closed", [True, False])
def test_spans_without_an_end(spark, closed):
    rng = random.Random(3)
    found = [(rng.choice("ab"), n, None if n % 17 == 16 else rng.uniform(-5, 60), None if n % 3 == 0 else rng.uniform(0, 70)) for n in range(60)]
    points = [(rng.choice(["a", "b", "c", None]), n, None if n % 29 == 28 else float(rng.randrange(60))) for n in range(200)]
    got = spans.points_in_spans(spark.createDataFrame(points, "k string, p int, t double"), spark.createDataFrame(found, "k string, s int, start double, end double"), "k", "t", 4.0, closed)
    fits = lambda t, end: end is None or (t <= end if closed else t < end)
    want = sorted((p, s) for k, p, t in points for key, s, start, end in found if k == key and None not in (t, start) and t >= start and fits(t, end))
    assert sorted((r.p, r.s) for r in got.collect()) == want and want
    joins = [line for line in plan_of(got).splitlines() if "Join" in line and "__bucket" not in line]
    assert joins and all("__to" in line for line in joins), "only open spans and their key's last point are joined on the key alone"


def cosines(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / size) if size else 0.0


def test_tag_products(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 3}" if i % 11 else None, i % 2, rng.normal(size=4 if i % 7 else 5).tolist()) for i in range(90)] + [("z", 0, [0.0] * 4), ("none", 0, None), ("bad", 0, [1.0, None, 2.0, 3.0]), ("nan", 1, [1.0, float("nan"), 0.0, 0.0])]
    tags = [(f"t{i}", rng.normal(size=4 if i % 5 else 5).tolist()) for i in range(23)] + [("zero", [0.0] * 4), ("null", None)]
    frame, names = spark.createDataFrame(rows, "scene string, half int, embedding array<double>"), spark.createDataFrame(tags, "tag_id string, t array<double>")
    want = {}
    for scene, half, v in rows:
        for tag, t in tags:
            s = cosines(v, t) if None not in (v, t) and len(v) == len(t) and not any(x is None or x != x for x in v) else None
            want[scene, half, tag] = max((x for x in (s, want.get((scene, half, tag))) if x is not None), default=None)
    for limit in (1 << 20, 300):  # one block and several
        got = {(r.scene, r.half, r.tag_id): r.best for r in scores.best_similarities(frame, names, ["scene", "half"], limit=limit).collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)
    assert scores.best_similarities(frame, names.limit(0), ["scene"]).count() == 0 == scores.best_similarities(frame.limit(0), names, ["scene"]).count()


def test_two_thousand_tags_take_one_scan(spark):
    tags = spark.range(2000).select(F.col("id").alias("tag_id"), F.array(*(F.sin(F.col("id") * k + 1) for k in range(1, 9))).alias("t"))
    rows = spark.range(700).select((F.col("id") % 5).alias("scene"), F.array(*(F.cos(F.col("id") * k) for k in range(1, 9))).alias("embedding"))
    out = scores.best_similarities(rows, tags, ["scene"])
    assert plan_of(out).count("MapInArrow") == 1 == plan_of(out).count("Range (")
    v = np.array([r.embedding for r in rows.orderBy("scene").collect()])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    t = np.array([r.t for r in tags.orderBy("tag_id").collect()])
    want = (unit(v) @ unit(t).T).reshape(5, 140, 2000).max(axis=1)
    got = np.array([r.best for r in out.orderBy("scene", "tag_id").collect()]).reshape(5, 2000)
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("threshold", [-0.5, 0.0, 0.3, 0.9])
def test_pivot_index_equals_all_pairs(spark, threshold):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    vector = lambda i: (centres[i % 12] + 0.15 * rng.normal(size=6)).tolist()
    others = [("j" if i % 4 else "k", i, i % 50, vector(i)) for i in range(400)]
    others += [("j", 900 + i, 60 + i, others[3 * i][3]) for i in range(20)]  # ties: the earlier one wins
    others += [("j", 990, 99, [0.0] * 6), ("j", 991, 99, None), ("j", 992, 99, [1.0, 2.0]), ("j", 993, 0, [float("nan")] * 6), (None, 994, 0, vector(0))]
    asked = [("j" if i % 3 else "k", i, vector(i * 5)) for i in range(60)] + [("j", 60, [0.0] * 6), ("j", 61, None), ("j", 62, [1.0, 2.0]), ("none", 63, vector(0)), ("j", 64, others[1][3])]
    want = {}
    for key, n, q in asked:
        for k, c, ord_, v in others:
            if k == key and None not in (q, v) and len(q) == len(v) and (s := cosines(q, v)) > threshold:
                rank = (round(s, 9), -ord_)
                if n not in want or rank > want[n][0]:
                    want[n] = (rank, c)
    seen = (Observation("first"), Observation("rest"))
    queries, candidates = spark.createDataFrame(asked, "job string, query_id long, vector array<double>"), spark.createDataFrame(others, "job string, candidate_id long, ord long, vector array<double>")
    got = clusters.best_matches(queries, candidates, "job", threshold, compared=seen).collect()
    place = {c: o for _, c, o, _ in others}
    assert {r.query_id: (round(r.similarity, 6), place[r.candidate_id]) for r in got} == {n: (round(rank[0], 6), place[c]) for n, (rank, c) in want.items()}
    every = sum(k == key for key, _, _ in asked for k, _, _, _ in others)
    assert sum(o.get["n"] for o in seen) < every / 3, "parts that can't beat the best are skipped"


def test_pivot_index_of_nothing(spark):
    asked = spark.createDataFrame([("j", 1, [1.0, 0.0])], "job string, query_id long, vector array<double>")
    none = spark.createDataFrame([], "job string, candidate_id long, ord long, vector array<double>")
    zero = spark.createDataFrame([("j", 5, 0, [0.0, 0.0])], none.schema)
    assert clusters.best_matches(asked, none, "job").count() == 0 == clusters.best_matches(asked, zero, "job").count()
    assert clusters.best_matches(asked, zero, "job", -0.1).head().similarity == 0.0


def test_copies_meet_a_query_once(spark):
    vector = lambda i: F.array(*(F.sin(i * k + 1) for k in range(1, 7)))
    queries = spark.range(300).select(F.lit("j").alias("job"), F.col("id").alias("query_id"), vector(F.col("id")).alias("vector"))
    copies = spark.range(3000).select(F.lit("j").alias("job"), F.col("id").alias("candidate_id"), (-F.col("id")).alias("ord"), vector(F.col("id") % 5).alias("vector"))
    seen = (Observation("first"), Observation("rest"))
    got = {r.query_id: (r.candidate_id, r.similarity) for r in clusters.best_matches(queries, copies, "job", -1.0, compared=seen).collect()}
    assert len(got) == 300 and {c for c, _ in got.values()} <= set(range(2995, 3000)) and all(got[i][0] == 2995 + i for i in range(5))
    assert sum(o.get["n"] for o in seen) <= 300 * 5, "copies aren't compared one by one"


def test_matches_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [("j" if i % 5 else "k", i, (rng.normal(size=3) * 10.0 ** rng.choice([-170, -3, 0, 3, 160])).tolist()) for i in range(300)]
    asked, others = rows[::10], [(k, i, i, v) for k, i, v in rows if i % 10]
    queries, candidates = spark.createDataFrame(asked, "job string, query_id long, vector array<double>"), spark.createDataFrame(others, "job string, candidate_id long, ord long, vector array<double>")
    # the exact cosine of each pair as a column, and the best by it
    pairs = queries.join(candidates.withColumnRenamed("vector", "c"), "job").withColumn("s", cosine(F.col("vector"), F.col("c"))).where("s > 0.2")
    want = pairs.groupBy("query_id").agg(F.max_by(F.struct("candidate_id", "s"), F.struct("s", -F.col("ord"))).alias("m")).select("query_id", "m.candidate_id", "m.s")
    told = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for block in (7, 8_192):
        assert told(clusters.best_matches(queries, candidates, "job", 0.2, block=block)) == told(want)


def arrivals(rows, n):
    """Uses in n files that a stream takes one after the other."""
    folder = tempfile.mkdtemp(prefix="spark-uses-")
    for i in range(n):
        part = pd.DataFrame(rows[i * len(rows) // n : (i + 1) * len(rows) // n], columns=["model", "at"])
        path = f"{folder}/{i:03d}.parquet"
        part.assign(at=pd.to_datetime(part["at"], unit="s", utc=True).astype("datetime64[us, UTC]")).to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def test_streamed_unloads_equal_the_batch(spark):
    rng = random.Random(11)
    uses = [(rng.choice(["clip", "face", None]), rng.randrange(0, 40_000)) for _ in range(300)]
    arrived = sorted(uses, key=lambda u: u[1] + rng.uniform(0, 1500))  # shuffled, but no more than 1500 s late
    folder = arrivals(arrived, 8)
    like = spark.read.parquet(folder)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    late = streams.LateRows()
    got = streams.run_once(streams.idle_unloads(stream, "model", "at", "300 seconds", "1500 seconds"), tempfile.mkdtemp(prefix="spark-state-"), late=late)
    shut = max(at for _, at in uses) - 1500
    want = resources.idle_sessions(like, "model", "at", "300 seconds").where(F.col("unloaded_at").cast("long") <= shut)
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    assert late.n == 0 and set(rows(got)) ^ set(rows(want)) == set(), shut
    assert rows(got) == rows(want) and want.count() > 20 and late.n == 0


def test_late_uses_are_counted(spark):
    folder = arrivals([("clip", 0), ("clip", 100), ("clip", 50_000), ("face", 50_001), ("clip", 50_010), ("face", 50_011), ("clip", 10), ("face", 20), ("clip", 60_000), ("face", 60_000)], 5)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    late = streams.LateRows()
    got = streams.run_once(streams.idle_unloads(stream, "model", "at", "300 seconds", "60 seconds"), tempfile.mkdtemp(prefix="spark-state-"), late=late)
    assert sorted((r.model, r.n_uses) for r in got.collect()) == [("clip", 2), ("clip", 2), ("face", 2)] and late.n == 2


def test_text_vectors(spark):
    asked = spark.sparkContext.accumulator(0)

    def encode(texts):
        asked.add(len(texts))
        return [[len(t), 1] for t in texts]

    rows = spark.createDataFrame([(i, None if i % 10 == 9 else f"text {i % 4}" * (i % 2)) for i in range(40)], "i int, text string")
    got = media.text_vectors(rows, "text", encode, 2).collect()
    assert len(got) == 40 and all(r.embedding == (None if r.text is None else [float(len(r.text)), 1.0]) for r in got)
    assert asked.value == 3  # '', 'text 1', 'text 3'
    for wrong in (lambda texts: [[1.0]] * len(texts), lambda texts: [[1.0, 2.0]]):
        with pytest.raises(Exception, match="encoder gave"):
            media.text_vectors(rows, "text", wrong, 2).collect()
    with pytest.raises(media.NoModel):
        media.text_vectors(rows, "text", None, 2)
    assert media.text_vectors(rows.limit(0), "text", encode, 2).count() == 0


def test_enhanced_images(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else bytes([i]) * (10 * i), "p" if i % 2 else None) for i in range(8)], "i int, image binary, prompt string").coalesce(1)

    def enhance(images, prompts):
        assert sum(map(len, images)) <= 100 or len(images) == 1
        return [None if b[:1] == b"\x05" else (p or "-").encode() + b[:1] for b, p in zip(images, prompts, strict=True)]

    got = {r.i: (r.image if r.image is None else bytes(r.image), r.enhanced) for r in media.enhance_images(rows, "image", enhance, F.col("prompt"), most_bytes=100).collect()}
    assert got[1] == (b"p\x01", True) and got[2] == (b"-\x02", True) and got[3] == (None, False) and got[5] == (b"\x05" * 50, False) and got[7] == (b"p\x07", True)
    with pytest.raises(media.NoModel):
        media.enhance_images(rows, "image", None)


def test_images_and_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-images-")
    for name in ("a.jpg", "b.jpg", "c.txt"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(name.encode())
    found = media.files(spark, folder, "*.jpg")
    assert sorted(bytes(r.content) for r in found.collect()) == [b"a.jpg", b"b.jpg"]
    path = found.where("path like '%a.jpg'").head().path
    rows = spark.createDataFrame([(1, "eHl6", path), (2, None, path), (3, None, "/none"), (4, None, None)], "i int, base64 string, path string")
    got = {r.i: r.image if r.image is None else bytes(r.image) for r in media.images_from(rows, found).collect()}
    assert got == {1: b"xyz", 2: b"a.jpg", 3: None, 4: None}
    assert bytes(media.images_from(rows.where("i = 1")).head().image) == b"xyz"
