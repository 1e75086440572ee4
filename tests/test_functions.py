from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heliograph.functions import intervals as iv
from heliograph.functions import quality as q
from heliograph.functions import text as t
from heliograph.functions import vectors as v


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(("side", "want"), [(0, 0), (20, 0), (40, 0.073529), (80, 0.25), (165, 0.625), (250, 1), (400, 1)])
def test_size(spark, side, want):
    assert value(spark, q.size_score(F.lit(side))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("angles", "want"), [((0, 0, 0), 1), ((60, 0, 0), 0.25), ((30, 45, 90), 0.625), ((90, 0, 0), 0), ((15, 0, 0), 0.933013)])
def test_pose(spark, angles, want):
    assert value(spark, q.pose_score(*map(F.lit, angles))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("pred", "prob", "want"), [(0, 0.9, 0.9625), (1, 0.9, 0.2875), (0, 0.5, 0.8125)])
def test_occlusion(spark, pred, prob, want):
    assert value(spark, q.raw_occlusion_score(F.lit(pred), F.lit(prob))) == pytest.approx(want)


def test_composite(spark):
    got = value(spark, q.face_quality(*map(F.lit, (165, 30, 45, 90, 0, 0.9, 0.8))))
    assert got.occlusion == pytest.approx(0.754808, abs=1e-6) and got.composite == pytest.approx(0.681731, abs=1e-6)


@pytest.mark.parametrize(("yaw", "roll", "want"), [(0, 0, "front"), (0, -16, "front-rotate-left"), (0, 16, "front-rotate-right"), (-16, 0, "left"), (15, 0, "right"), (0, 15, "right"), (-15, 0, "right"), (0, -15, "right")])
def test_pose_bucket_at_the_edges(spark, yaw, roll, want):
    assert value(spark, q.pose_bucket(F.lit(yaw), F.lit(roll))) == want


@pytest.mark.parametrize(
    ("duration", "step", "want"),
    [(5.0, 2.0, [0, 2, 4]), (4.05, 2.0, [0, 2, 3.95]), (0.05, 2.0, [-0.05])],
)
def test_interval_times(spark, duration, step, want):
    assert value(spark, iv.interval_times(F.lit(duration), F.lit(step))) == pytest.approx(want)


def test_interval_times_of_a_long_video(spark):
    want, t = [], 0.0
    while t < 7200.0:
        want.append(min(t, 7199.9))
        t += 0.1
    assert list(value(spark, iv.interval_times(F.lit(7200.0), F.lit(0.1)))) == want


def test_interval_times_drift(spark):
    got = value(spark, iv.interval_times(F.lit(1.0), F.lit(0.1)))
    assert len(got) == 11 and got[-1] == pytest.approx(0.9)


def test_scene_times(spark):
    arrays = [F.array(*map(F.lit, x)) for x in ((0.0, 4.0), (4.0, 12.0))]
    assert value(spark, iv.scene_times(*arrays, F.lit(10.0))) == pytest.approx([1, 2, 3, 6, 8])


def test_resampling(spark):
    items = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    assert value(spark, iv.resample16(items(20))) == [0, 1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 19]
    assert value(spark, iv.resample16(items(3))) == [0, 1] + [2] * 14
    assert value(spark, iv.even_places(F.lit(7), F.lit(3))) == [0, 2, 4]
    assert value(spark, iv.even_places(F.lit(30), F.lit(22))) == [int(i * (30 / 22)) for i in range(22)]


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, x)) for x in ((3.0, 4.0), (4.0, 3.0), (0.0, 0.0)))
    assert value(spark, v.cosine(a, b)) == pytest.approx(0.96) and value(spark, v.cosine(a, zero)) == 0.0
    assert value(spark, v.l2_normalise(a)) == pytest.approx([0.6, 0.8])
    assert value(spark, v.softmax2(F.lit(1.0), F.lit(1.0))).label == 0


@pytest.mark.parametrize(
    ("caption", "want"),
    [
        ("A photograph of a photo", "Frame 3: A video frame of a photo"),
        ("Close image of an image", "Frame 3: Close video frame of an image"),
        ("photography class", "Frame 3: photography class"),
        ("", "Frame 3: "),
        (None, "Frame 3: "),
    ],
)
def test_fix_caption(spark, caption, want):
    assert value(spark, t.fix_caption(F.lit(caption).cast("string"), F.lit(3))) == want


def test_clean_caption(spark):
    raw = "This image shows a dog. There is a Watermark here. It has compression artifacts. Low resolution.  A\n cat sits."
    assert value(spark, t.clean_caption(F.lit(raw))) == "The frame shows a dog. A cat sits."


@pytest.mark.parametrize(("text", "least", "want"), [("I can't help with that", None, True), ("As an AI I", None, True), ("A fine day.", None, False), ("A fine day.", 200, True), ("  ", None, True), (None, None, True)])
def test_refusals(spark, text, least, want):
    assert value(spark, t.is_refusal(F.lit(text).cast("string"), least)) is want


@pytest.mark.parametrize(("raw", "want"), [('\n  Title: "A Day Out" \nmore', "A Day Out"), ("Sure, - “Hi”", "Hi"), ("Here's the title: x", "x"), ("", ""), (None, "")])
def test_clean_title(spark, raw, want):
    assert value(spark, t.clean_title(F.lit(raw).cast("string"))) == want


def test_cache_key(spark):
    params = t.canonical_json({"b": F.lit("[1, 2]"), "a": F.lit("0.9")})
    assert value(spark, params) == '{"a": 0.9, "b": [1, 2]}'
    assert value(spark, t.cache_key(F.lit("/v.mp4"), F.lit(0), "faces", params)) == "b5951d865b9b1ef34510ac2cbb8fb1cc36e3fc67177055ac7583c269eb92fd99"


@pytest.mark.parametrize(("seconds", "words", "short", "clock"), [(None, "Unknown", "-", "—"), (0.0, "Unknown", "0.0s", "—"), (59.9, "59s", "59.9s", "0:59"), (125.0, "2m 5s", "2m 5s", "2:05"), (3725.0, "62m 5s", "1h 2m", "1:02:05")])
def test_durations(spark, seconds, words, short, clock):
    s = F.lit(seconds).cast("double")
    assert (value(spark, t.duration_words(s)), value(spark, t.duration_short(s)), value(spark, t.duration_clock(s))) == (words, short, clock)


@pytest.mark.parametrize(("path", "want"), [("short.mp4", "short.mp4"), ("/a/very/long/path/to/some/where/file.mp4", "/a/very/long/path/to/some/where/file.mp4"), ("/a/very/long/path/to/some/where/else/file.mp4", ".../file.mp4"), ("/x/" + "n" * 50, "..." + "n" * 37)])
def test_truncate_path(spark, path, want):
    assert value(spark, t.truncate_path(F.lit(path))) == want


@pytest.mark.parametrize(("text", "want"), [("2024-01-01T00:00:10.000Z", 1704067210.0), ("1704067210", 1704067210.0), ("soon", None), (None, None)])
def test_parse_time(spark, text, want):
    assert value(spark, t.parse_time(F.lit(text).cast("string"))) == want
