from __future__ import annotations

import hashlib
import os
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import vectors
from heliograph.operators import clusters, decode, jobs, ordered, resources, spans, taxonomy
from heliograph.sources import content_hash, media, stores, vtt
from heliograph.sources import taxonomy as tag_source

JOB = "job_id long, service string, status string, source string, source_id string, created_at string, cache_key string, completed_at string, progress double"


def job_rows(spark):
    rows = [
        (1, "faces", "completed", None, "a", None, "k", None, None), (2, "scenes", "failed", "s", None, "soon", "k", None, None), (3, "vision", "completed", "s", "a", "2024-01-01T00:00:10Z", "k", None, 1.0),
        (4, "faces", "completed", "s", "a", "1704067210", None, None, None), (5, "semantics", "queued", "s", "b", "2024-01-01T00:00:11Z", "z", None, None),
    ]
    return spark.createDataFrame(rows, JOB)


def ids(df):
    return [r.job_id for r in df.collect()]


def test_job_filters_and_pages(spark):
    j = job_rows(spark)
    assert sorted(ids(jobs.filter_jobs(j, since=1704067210.0))) == [1, 3, 4, 5]
    assert sorted(ids(jobs.filter_jobs(j, until=1704067210.0))) == [1, 2, 3, 4]
    assert sorted(ids(jobs.filter_jobs(j, status="", source="s"))) == [2, 3, 4, 5]
    assert ids(jobs.page(j, 10)) == [5, 3, 4, 1, 2]
    assert ids(jobs.page(j, 2)) + ids(jobs.page(j, 2, 2)) + ids(jobs.page(j, 2, 4)) == [5, 3, 4, 1, 2]
    assert ids(jobs.page(j, 10, dedupe_by_cache_key=True)) == [5, 3, 4]
    assert jobs.next_offset(0, 2, 5) == 2 and jobs.next_offset(4, 2, 5) is None
    counts = {r.service: r.n_jobs for r in jobs.count_by_service(j).collect()}
    assert counts == {"vision": 1, "faces": 2, "scenes": 1, "semantics": 1, "objects": 0, "captions": 0}


def test_stores(spark):
    j = job_rows(spark)
    assert stores.lookup(j, "3", "vision").count() == 1
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, None)], "id long, name string")
    asked = spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 9), (13, 9)], "n int, id long")
    assert sorted((r.n, r.found, r.row.name if r.found else None) for r in stores.lookup_each(asked, rows, ["id"]).collect()) == [(10, True, "a"), (11, True, None), (12, False, None), (13, False, None), (13, False, None)]
    assert stores.lookup_each(asked, rows.limit(0), ["id"]).where("found").count() == 0
    good, stale = stores.valid_cache(spark.createDataFrame([("k", 1), ("l", 99)], "cache_key string, job_id long"), j, ["job_id"])
    assert good.count() == 1 and stale.head().job_id == 99
    hops = spark.createDataFrame([(10, 11), (11, 12)], "alias_job_id long, target_job_id long")
    assert {r.job_id: r.resolved for r in stores.resolve_alias(spark.createDataFrame([(10,), (11,), (12,)], "job_id long"), hops).collect()} == {10: 11, 11: 12, 12: 12}
    log = spark.createDataFrame([(1, 1, "load", "x"), (1, 2, "", None), (1, 3, None, "y")], "job long, seq long, stage string, status string")
    assert tuple(stores.fold_updates(log, "job", ["seq"], ["stage"], ["status"]).head()) == (1, "load", "y")
    decoded = stores.decode_json(spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,)], "raw string"), "raw", "a int")
    assert [r.doc.a for r in decoded.collect()] == [1]
    assert stores.same_set(spark.range(3), spark.range(3).union(spark.range(2))) and not stores.same_set(spark.range(3), spark.range(4))


def test_scene_joins(spark):
    found = spark.createDataFrame([("v", 0, 0.0, 4.0), ("v", 1, 4.0, 9.0), ("v", 2, 20.0, None)], "k string, scene int, start double, end double")
    points = spark.createDataFrame([("v", t) for t in (0.0, 4.0, 8.9, 9.5, 25.0)], "k string, t double")
    met = sorted((r.t, r.scene) for r in spans.points_in_spans(points, found, "k", "t", 2.5).collect())
    assert met == [(0.0, 0), (4.0, 0), (4.0, 1), (8.9, 1), (25.0, 2)]
    half = spans.points_in_spans(points, found.where("end is not null"), "k", "t", 2.5, closed=False)
    assert sorted((r.t, r.scene) for r in half.collect()) == [(0.0, 0), (4.0, 1), (8.9, 1)]


def test_nearest_entry(spark):
    cues = spark.createDataFrame([("v", 0.0, 2.0, 0), ("v", 2.0, 4.0, 1), ("v", 10.0, 12.0, 2)], "k string, start double, end double, ord int")
    asked = spark.createDataFrame([("v", 1.9, 1), ("v", 2.0, 2), ("v", 6.0, 3), ("v", 6.1, 4), ("v", 99.0, 5), ("v", -1.0, 6), ("w", 1.0, 7)], "k string, t double, n int")
    got = {r.n: r.entry_ord for r in spans.nearest_start(asked, cues, "k", ["n"], "t").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 0, 7: None}


def test_top_and_thin(spark):
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate((0.04, 0.5, 0.9, 0.9, 0.1))], "s string, i int, score double")
    assert [r.i for r in spans.top_n(rows, ["s"], "score", ["i"], 3, 0.05).orderBy("rank").collect()] == [2, 3, 1]
    for n, k in ((7, 3), (30, 22), (5, 9), (100, 7)):
        many = spark.range(n).withColumn("k", F.lit(1))
        want = sorted({int(i * (n / k)) for i in range(k)}) if n > k else list(range(n))
        assert sorted(r.id for r in spans.thin(many, "k", ["id"], k).collect()) == want


def test_cues(spark):
    text = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\ns.jpg#xywh=0,90,160,90\n\n00:00:03.000 --> 00:00:04.000\ns.jpg\n\n100:00:05.000 --> 100:00:06.000\ns.jpg#xywh=1,2,3,4\n"
    rows = spark.createDataFrame([("v", text), ("w", "")], "k string, vtt string")
    assert [(r.start, r.end, r.y) for r in vtt.strict_cues(rows, "k").collect()] == [(1.0, 2.5, 90)]
    assert [(r.start, r.w) for r in vtt.loose_cues(rows, "k").orderBy("start").collect()] == [(1.0, 160), (360005.0, 3)]


def leaders(vectors, threshold):
    heads, out = [], []
    for x in vectors:
        hit = next((i for i, h in enumerate(heads) if np.dot(h, x) / max(1e-12, np.linalg.norm(h) * np.linalg.norm(x)) >= threshold), None)
        if hit is None:
            heads.append(x)
            hit = len(heads) - 1
        out.append(hit)
    return out


def test_leader_clusters(spark):
    rng = np.random.default_rng(4)
    data = {job: [rng.normal(size=6) for _ in range(60)] for job in ("a", "b")}
    rows = [(job, i, [float(y) for y in x]) for job, xs in data.items() for i, x in enumerate(xs)]
    rows.append(("a", 60, [0.0] * 6))
    random.Random(1).shuffle(rows)
    got = clusters.leader_clusters(spark.createDataFrame(rows, "job string, i int, v array<double>"), "job", ["i"], "v", 0.5).collect()
    for job, xs in data.items():
        mine = [r.cluster for r in sorted((r for r in got if r.job == job and r.i < 60), key=lambda r: r.i)]
        assert mine == leaders(xs, 0.5)
    assert next(r.cluster for r in got if r.i == 60) == max(r.cluster for r in got if r.job == "a")


@pytest.mark.parametrize(("block", "chunk"), [(1, 7), (5, 3), (16, 1000)])
def test_leader_clusters_in_rounds(spark, block, chunk):
    rng = np.random.default_rng(6)
    data = {job: [rng.normal(size=4) for _ in range(n)] for job, n in (("a", 45), (None, 12), ("c", 1))}
    rows = [(job, i, [float(y) for y in x]) for job, xs in data.items() for i, x in enumerate(xs)]
    rows += [("a", 45, None), ("a", 46, [0.0] * 4), ("a", 47, None), ("d", 0, None)]
    random.Random(2).shuffle(rows)
    got = clusters.leader_clusters(spark.createDataFrame(rows, "job string, i int, v array<double>"), "job", ["i"], "v", 0.6, block, chunk).collect()
    assert len(got) == len(rows)
    for job, xs in data.items():
        mine = [r.cluster for r in sorted((r for r in got if r.job == job and r.i < 45), key=lambda r: r.i)]
        assert mine == leaders(xs, 0.6)
    last = max(leaders(data["a"], 0.6))
    assert sorted((r.i, r.cluster) for r in got if r.job == "a" and r.i >= 45) == [(45, last + 1), (46, last + 2), (47, last + 3)]
    assert clusters.leader_clusters(spark.createDataFrame([], "job string, i int, v array<double>"), "job", ["i"], "v").count() == 0


def test_running_sums_of_one_key_in_many_tasks(spark):
    rng = random.Random(3)
    rows = [("g", rng.randrange(50), i, None if i % 7 == 0 else float(rng.randrange(100))) for i in range(3000)] + [(None, 1, -1, 5.0), ("h", 0, -2, None), ("h", 1, -3, 2.0)]
    frame = spark.createDataFrame(rows, "d string, p int, i int, mb double")
    got = ordered.running(frame, ["d"], ["p", "i"], {"so_far": "mb"}, "place", parts=9).collect()
    want = {}
    for d in ("g", None, "h"):
        total = None
        for place, (_, _, i, mb) in enumerate(sorted((r for r in rows if r[0] == d), key=lambda r: r[1:3]), 1):
            total = total if mb is None else (total or 0.0) + mb
            want[i] = (place, total)
    assert {r.i: (r.place, r.so_far) for r in got} == want and len(got) == len(rows)
    spread = ordered.running(frame, ["d"], ["p", "i"], place="n", parts=9).groupBy(F.spark_partition_id()).count()
    assert spread.count() > 1
    whole = resources.queue(frame.withColumnRenamed("mb", "vram_mb"), "d", ["p", "i"], F.lit(400.0))
    assert {r.i: r.position for r in whole.collect()} == {i: n for i, (n, _) in want.items()}
    assert {r.i for r in whole.where("granted").collect()} == {i for i, (_, s) in want.items() if s is not None and s <= 400}


def test_representative_and_match(spark):
    members = spark.createDataFrame([("j", 0, 0, 0.5), ("j", 0, 1, 0.9), ("j", 0, 2, 0.9), ("j", 1, 3, 0.1)], "job string, cluster int, i int, q double")
    assert {r.cluster: r.i for r in clusters.representatives(members, ["job", "cluster"], "q", "i", []).collect()} == {0: 1, 1: 3}
    asked = spark.createDataFrame([("j", 1, [1.0, 0.0])], "job string, query_id long, vector array<double>")
    others = spark.createDataFrame([("j", 7, 0, [0.6, 0.8]), ("j", 8, 1, [0.8, 0.6]), ("j", 9, 2, [0.8, 0.6])], "job string, candidate_id long, ord long, vector array<double>")
    assert clusters.best_matches(asked, others, "job", 0.6).head().candidate_id == 8
    assert clusters.best_matches(asked, others.where("candidate_id = 7"), "job", 0.6).count() == 0


def taxonomy_tables(spark):
    nodes = spark.createDataFrame([(i, i.upper(), n) for n, i in enumerate(["root", "a", "b", "c", "d", "lone"])], "id string, name string, ord long")
    edges = spark.createDataFrame([("a", "root", 0), ("b", "root", 0), ("c", "a", 0), ("c", "root", 1), ("d", "c", 0), ("d", "b", 1)], "child_id string, parent_id string, ord int")
    return nodes, edges


def test_taxonomy(spark):
    nodes, edges = taxonomy_tables(spark)
    paths = sorted((r.id, "/".join(r.path)) for r in taxonomy.paths(nodes, edges, "root").collect())
    assert paths == [("a", "ROOT"), ("b", "ROOT"), ("c", "ROOT"), ("c", "ROOT/A"), ("d", "ROOT/A/C"), ("d", "ROOT/B"), ("d", "ROOT/C")]
    tags = {r.id: r for r in taxonomy.enrich(nodes, edges, "root").collect()}
    assert tags["c"].path == ["ROOT"] and tags["c"].parent_id == "a" and not tags["c"].is_leaf
    assert tags["d"].path == ["ROOT", "C"] and tags["d"].path_count == 3 and tags["d"].is_leaf and tags["lone"].all_paths == [[]]
    assert taxonomy.root_of(nodes, edges).head().root == "root"
    assert {r.id for r in taxonomy.within(nodes, edges, "a").collect()} == {"a", "c", "d"}
    loop = edges.union(spark.createDataFrame([("a", "d", 5)], edges.schema))
    assert taxonomy.descendants(loop, spark.createDataFrame([("a",)], "id string")).count() == 3


def test_hierarchical_decode(spark):
    parents = {"A": "R", "B": "R", "A1": "A", "A2": "A", "A3": "A", "A1b": "A", "A1x": "A1b"}
    leaves = {"B", "A1", "A2", "A3", "A1x"}
    tags = spark.createDataFrame([(k, k, p, k in leaves, "") for k, p in parents.items()], "id string, name string, parent_id string, is_leaf boolean, path_string string")
    given = {"A": 0.65, "B": 0.90, "A1": 0.95, "A2": 0.88, "A3": 0.80, "A1b": 0.50, "A1x": 0.85}
    scores = spark.createDataFrame([("s", k, x) for k, x in given.items()], "scene string, tag_id string, score double")
    got = decode.hierarchical(scores, tags, "scene")
    assert [(r.tag_id, r.decode_type) for r in got.orderBy("rank").collect()] == [("A1", "direct"), ("B", "competition"), ("A2", "direct"), ("A1x", "competition"), ("A3", "direct")]
    assert {r.tag_id for r in decode.supporting(got, tags, "scene").collect()} == {"A", "A1b", "R"}


@pytest.mark.parametrize("name", ["decode_by_type", "decode_support"])
def test_decoders_do_not_walk_the_taxonomy(spark, data, name, monkeypatch):
    from heliograph.plans.registry import QUERIES

    def refuse(*_):
        raise AssertionError("no path is needed")

    starts, closure = [], decode.ancestors
    monkeypatch.setattr(taxonomy, "shortest", refuse)
    monkeypatch.setattr(taxonomy, "path_counts", refuse)
    monkeypatch.setattr(decode, "ancestors", lambda edges, nodes: starts.append(nodes.count()) or closure(edges, nodes))
    assert QUERIES[name](spark, data).count() > 0
    assert all(n <= 31 for n in starts), "the closure starts from the inner tags: root, regions, nations"


def test_decode_equals_joins(spark):
    rng = random.Random(4)
    parents = {f"t{i}": "" if i < 3 else f"t{rng.randrange(i)}" if i % 9 else "out" for i in range(60)} | {"x": "y", "y": "x"}
    tags = spark.createDataFrame([(k, p, k not in parents.values()) for k, p in parents.items()], "id string, parent_id string, is_leaf boolean")
    given = [(s, t, round(rng.uniform(0.4, 1.0), 2)) for s in ("a", "b", None) for t in [*parents, "out", "none"] if rng.random() < 0.8]
    scores = spark.createDataFrame(given, "scene string, tag_id string, score double")
    tags.createOrReplaceTempView("some_tags"), scores.createOrReplaceTempView("some_scores")
    want = spark.sql("""select scene, tag_id, if(direct, 'direct', 'competition') as kind from (
      select s.scene, s.tag_id, (t.parent_id = '' or coalesce(p.score, 0) >= 0.60) and s.score >= if(t.is_leaf, 0.78, 0.60) as direct,
        max(s.score) over (partition by s.scene, t.parent_id) as top, s.score, row_number() over (partition by s.scene, t.parent_id order by s.score desc, s.tag_id) as place
      from some_scores s join some_tags t on t.id = s.tag_id left join some_scores p on p.scene = s.scene and p.tag_id = t.parent_id)
      where direct or (top >= 0.78 and top - score <= 0.08 and place <= 2)""")
    found = decode.hierarchical(scores, tags, "scene")
    kept = {(r.scene, r.tag_id, r.kind) for r in want.collect()}
    assert {(r.scene, r.tag_id, r.decode_type) for r in found.collect()} == kept and len(kept) == found.count()
    up = set()
    for scene, tag, _ in kept:
        at, seen = parents[tag], set()
        while at and at not in seen:
            seen.add(at)
            at = parents.get(at)
        up |= {(scene, a) for a in seen if a != tag and (scene is None or not any(k[:2] == (scene, a) for k in kept))}
    got = decode.supporting(found, tags, "scene")
    assert {(r.scene, r.tag_id) for r in got.collect()} == up and len(up) == got.count()


def test_grants_stop_at_the_first_that_does_not_fit(spark):
    rows = spark.createDataFrame([("g", 1, 10.0), ("g", 2, 50.0), ("g", 3, 5.0)], "d string, i int, vram_mb double")
    assert [r.granted for r in resources.grants(rows, "d", ["i"], F.lit(20.0)).orderBy("i").collect()] == [True, False, False]


def test_deep_taxonomies_and_cycles(spark):
    nodes = spark.createDataFrame([(f"t{i}", f"n{i}", i) for i in range(41)], "id string, name string, ord long")
    chain = [(f"t{i + 1}", f"t{i}", 0) for i in range(40)]
    edges = spark.createDataFrame(chain, "child_id string, parent_id string, ord int")
    deep = {r.id: r for r in taxonomy.enrich(nodes, edges, "t0").collect()}
    assert deep["t40"].depth == 40 and deep["t40"].path_string.startswith("n0 > n1 > ") and deep["t40"].path_count == 1
    assert taxonomy.descendants(edges, nodes.where("id = 't0'")).count() == 41 and taxonomy.ancestors(edges, nodes.where("id = 't40'")).count() == 40
    assert taxonomy.root_of(nodes, edges).head() == ("t0", 41) and taxonomy.family(edges, nodes.where("id = 't3'")).count() == 3
    looped = spark.createDataFrame([*chain[:5], ("t2", "t4", 1), ("t3", "t3", 1)], "child_id string, parent_id string, ord int")
    paths = {(r.id, tuple(r.path)) for r in taxonomy.paths(nodes, looped, "t0").collect()}
    assert paths == {(f"t{i}", tuple(f"n{k}" for k in range(i))) for i in range(1, 6)}
    assert taxonomy.descendants(looped, nodes.where("id = 't2'")).count() == 4 and taxonomy.ancestors(looped, nodes.where("id = 't2'")).count() == 4


def test_mean_bias_is_added_and_normalised(spark):
    rows = spark.createDataFrame([([3.0, 0.0], [[0.0, 4.0], [0.0, 4.0]]), ([0.0, 2.0], [])], "v array<double>, b array<array<double>>")
    got = [list(r.x) for r in rows.select(vectors.with_mean_bias(F.col("v"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == pytest.approx([0.0, 1.0])


def test_cuts_by_method(spark):
    rows = spark.createDataFrame([("v", i, i * 0.5, s) for i, s in enumerate([1.0, 30.0, 31.0, 2.0, 1.0, 40.0, 1.0, 1.0])], "k string, i int, t double, s double")
    cut = lambda m, x: [r.i for r in spans.cuts(rows, "k", ["i"], "s", "t", m, x).where("cut").orderBy("i").collect()]
    assert cut("content", 27.0) == [1, 5] and cut("threshold", 27.0) == [1, 5] and cut("adaptive", 3.0) == [2, 5]
    with pytest.raises(ValueError, match="method"):
        spans.cuts(rows, "k", ["i"], "s", "t", "other")


def kept_by_a_walk(times, least):
    out, last = [], None
    for t in sorted(times):
        if last is None or t >= last + least:
            out.append(t)
            last = t
    return out


def test_cuts_equal_a_walk(spark):
    rng = random.Random(5)
    runs = {"even": [i * 0.5 for i in range(20)], "one": [3.0], "same": [1.0] * 5, "burst": sorted(rng.choice([0.0, 4.0, 9.0]) + rng.random() for _ in range(200)), "long": sorted(rng.random() * 300 for _ in range(700))}
    rows = [(k, i, t, 9.0) for k, ts in runs.items() for i, t in enumerate(ts)] + [(None, i, float(i), 9.0) for i in range(4)] + [("quiet", i, float(i), 0.0) for i in range(4)]
    frame = spark.createDataFrame(rows, "k string, i int, t double, s double")
    for least in (0.6, 2.0, 0.0):
        got = {}
        for r in spans.cuts(frame, "k", ["i"], "s", "t", "content", 5.0, least).where("cut").collect():
            got.setdefault(r.k, []).append(r.t)
        assert {k: sorted(v) for k, v in got.items()} == {k: kept_by_a_walk(ts, least) if least else sorted(ts) for k, ts in [*runs.items(), (None, [0.0, 1.0, 2.0, 3.0])]}
    assert spans.cuts(frame, "k", ["i"], "s", "t").count() == len(rows)
    assert spans.cuts(frame, "k", ["i"], "s", "t", "content", 5.0).where("k = 'even' and cut").count() == 10


def test_fades(spark):
    scores = [20.0, 5.0, None, 4.0, 30.0, 31.0, 2.0, 40.0, 3.0]
    frame = spark.createDataFrame([("a", i, float(i), s) for i, s in enumerate(scores)] + [("b", 0, 0.0, 1.0), ("b", 1, 2.0, 50.0), ("c", 0, 0.0, None)], "k string, i int, t double, s double")
    told = lambda bias: sorted(tuple(r) for r in spans.fades(frame, "k", ["i"], "s", "t", 12.0, bias).collect())
    assert told(0.0) == [("a", 1.0, 4.0, 2.5), ("a", 6.0, 7.0, 6.5), ("b", 0.0, 2.0, 1.0)]
    assert [x[3] for x in told(-1.0)] == [1.0, 6.0, 0.0] and [x[3] for x in told(1.0)] == [4.0, 7.0, 2.0]


def test_paths_are_counted_without_listing_them(spark):
    names = [f"{k}{i}" for i in range(8) for k in "xyz"]
    nodes = spark.createDataFrame([(n, n.upper(), i) for i, n in enumerate([*names, "lone"])], "id string, name string, ord long")
    stack = [(f"{k}{i}", f"x{i}", 0) for i in range(7) for k in "yz"] + [(f"x{i + 1}", f"{k}{i}", o) for i in range(7) for o, k in enumerate("yz")]
    edges = spark.createDataFrame([*stack, ("y0", "y0", 1), ("x3", "y2", 7)], "child_id string, parent_id string, ord int")
    tags = {r.id: r for r in taxonomy.summary(nodes, edges, "x0").collect()}
    assert tags["x7"].path_count == 2**7 and tags["x7"].depth == 14 and tags["x7"].path_string.endswith("X6 > Y6")
    assert tags["lone"].path_count == 1 and tags["lone"].path == [] and tags["x0"].depth == 0
    counts = {r.id: (int(r.n_paths), r.longest) for r in taxonomy.path_counts(nodes, edges, "x0").collect()}
    assert counts["z6"] == (2**6, 13) and "lone" not in counts and "z7" not in counts


def test_summary_equals_the_listing_and_leaves_cycles_uncounted(spark):
    rng = random.Random(7)
    ids = [f"t{i}" for i in range(14)]
    nodes = spark.createDataFrame([(n, n.upper(), i) for i, n in enumerate(ids)], "id string, name string, ord long")
    links = [(ids[i], p, o) for i in range(1, 14) for o, p in enumerate(rng.sample(ids[:i], min(i, rng.randrange(1, 4))))]
    edges = spark.createDataFrame(links, "child_id string, parent_id string, ord int")
    listed = {r.id: r for r in taxonomy.enrich(nodes, edges, "t0").collect()}
    for r in taxonomy.summary(nodes, edges, "t0").collect():
        a = listed[r.id]
        assert (r.path, r.path_string, r.depth, r.path_count, r.parent_id, r.all_parent_ids, r.is_leaf) == (a.path, a.path_string, a.depth, a.path_count, a.parent_id, a.all_parent_ids, a.is_leaf)
    looped = spark.createDataFrame([("a", "r", 0), ("b", "a", 0), ("a", "b", 1), ("c", "b", 0), ("d", "r", 0), ("r", "d", 0)], edges.schema)
    few = spark.createDataFrame([(n, n, i) for i, n in enumerate("rabcd")], nodes.schema)
    assert {r.id: r.path_count for r in taxonomy.summary(few, looped, "r").collect()} == {"r": 1, "a": None, "b": None, "c": None, "d": 1}
    assert {r.id: r.depth for r in taxonomy.summary(few, looped, "r").collect()} == {"r": 0, "a": 1, "b": 2, "c": 3, "d": 1}


def sampled(data: bytes) -> str:
    h = hashlib.sha256(str(len(data)).encode())
    h.update(data[:8192])
    if len(data) > 16384:
        h.update(data[-8192:])
    if len(data) > 32768:
        h.update(data[len(data) // 2 :][:8192])
    return h.hexdigest()


def test_content_hashes_of_files_and_columns(spark, tmp_path):
    rng = random.Random(9)
    held = {f"f {n}.bin": rng.randbytes(n) for n in (0, 1, 8191, 8192, 8193, 16384, 16385, 32768, 32769, 40960)}
    (tmp_path / "in").mkdir()
    for name, data in held.items():
        (tmp_path / "in" / name).write_bytes(data)
    empty = spark.createDataFrame([(f"file:{tmp_path}/in/f 0.bin", 0)], "path string, length long")
    got = content_hash.file_hashes(content_hash.listed(spark, str(tmp_path)).unionByName(empty)).collect()
    assert {(os.path.basename(urllib.parse.unquote(r.path)), r.length, r.content_hash) for r in got} == {(n, len(d), sampled(d)) for n, d in held.items()}
    frame = spark.createDataFrame([(n, bytearray(d)) for n, d in held.items()] + [("none", None)], "n string, b binary")
    assert {r.n: r.h for r in frame.select("n", content_hash.content_hash(F.col("b")).alias("h")).collect()} == {n: sampled(d) for n, d in held.items()} | {"none": None}
    gone = spark.createDataFrame([(f"file:{tmp_path}/in/none", 4)], "path string, length long")
    assert content_hash.file_hashes(gone).head().content_hash == ""


def test_cache_keys_of_temporary_files_go_by_content(spark):
    rows = spark.createDataFrame([("/tmp/a", "h1"), ("/var/tmp/b", "h1"), ("/tmp/c", ""), ("/media/a", "h1")], "p string, h string")
    key = [r.k for r in rows.select(content_hash.content_cache_key(F.col("p"), F.lit(5), "m", F.lit("{}"), F.col("h")).alias("k")).collect()]
    by = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert key == [by("content:h1:m:{}"), by("content:h1:m:{}"), by("/tmp/c:5:m:{}"), by("/media/a:5:m:{}")]


def test_file_hash_query_reads_the_given_files(spark, data):
    from heliograph.plans.registry import QUERIES

    got = {r.path: r.content_hash for r in QUERIES["file_hashes"](spark, data).collect()}
    want = {f: sampled(open(os.path.join(at, f), "rb").read()) for at, _, names in os.walk(data) for f in names if f.endswith(".parquet")}
    assert got == want


def test_set_difference(spark):
    assert tuple(stores.set_difference(spark.range(5), spark.range(3, 6)).head()) == (3, 1, False)


def test_lease_expiry_of_the_silent(spark):
    got = [value for (value,) in spark.range(1).select(F.array(*(resources.expired(F.lit(n), F.lit(600), F.lit(b), F.lit(busy)) for n, b, busy in ((601, 600, True), (100, 39, False), (100, 39, True), (100, 40, False))))).collect()][0]
    assert got == [True, True, False, False]


def test_tag_sources(spark):
    tag = '{"id": "1", "name": "x", "parents": [{"id": "0", "name": "r"}], "children": [{"id": "2", "name": "y"}]}'
    payloads = [f'{{"data": {{"findTags": {{"tags": [{tag}]}}}}}}', f'{{"tags": [{tag}]}}', f"[{tag}]"]
    for p in payloads:
        tags = tag_source.tags_of(spark.createDataFrame([(p,)], "payload string"))
        nodes, edges = tag_source.nodes_and_edges(tags)
        assert nodes.count() == 1 and {(r.child_id, r.parent_id) for r in edges.collect()} == {("1", "0"), ("2", "1")}
    with pytest.raises(Exception, match="taxonomy"):
        tag_source.tags_of(spark.createDataFrame([('{"x": 1}',)], "payload string")).collect()
    everything = [{"id": str(i), "name": f"t{i}"} for i in range(23)]
    fetch = lambda page, size: (everything[(page - 1) * size : page * size], 23)
    assert tag_source.paged_tags(spark, fetch, 5).count() == 23


def test_model_boundaries(spark):
    with pytest.raises(media.NoModel):
        media.detect_faces(spark.range(1), None)
    videos = spark.createDataFrame([("v", i, i / 2, bytearray(b"x" * i)) for i in range(3)], "key string, frame_index int, timestamp double, content binary")
    chain = [("first", lambda c, t: None if len(c) < 2 else c), ("second", lambda c, t: c or None)]
    assert [(r.frame_index, r.decoder) for r in media.decode_frames(videos, chain).orderBy("frame_index").collect()] == [(1, "second"), (2, "first")]
    tries = lambda prompts: ["" if "bad" in p else p.upper() for p in prompts]
    said = spark.createDataFrame([("hi",), ("bad",)], "p string").select(media.text_model(F.col("p"), tries).alias("t")).collect()
    assert [r.t for r in said] == ["HI", ""]
