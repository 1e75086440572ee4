"""Face and frame quality, vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import quality as q
from ..functions import vectors as v
from ..operators import clusters
from ..operators.scores import best_similarities, best_tags
from .base import query, table

# Faces: a line item's numbers scaled to pixels, degrees and probabilities.
FACES_SQL = """
faces as (
  select l_orderkey * 8 + l_linenumber as face, cast(l_quantity * 8 as bigint) as side, l_partkey % 121 - 60.0 as yaw, l_suppkey % 91 - 45.0 as pitch, l_orderkey % 181 - 90.0 as roll,
    l_linenumber % 2 as pred, l_discount * 10 as prob, case when l_linenumber = 7 then null else l_tax * 10 end as sharp from lineitem)
"""
LINE = "case when {x} >= {x1} then {y1} when {x} > {x0} then {y0} + ({x} - {x0}) * {dy} / {dx} else greatest({y0} - ({x0} - {x}) * {dy} / {dx}, 0) end"


def line(x, x0, x1, y0, y1):
    return LINE.format(x=x, x0=x0, x1=x1, y0=y0, y1=y1, dy=y1 - y0, dx=x1 - x0)


POSE = "greatest(0, pow(cos(radians(least(90, {y}))), 2) / (least(1, {y} / 60) * (least(1, abs(pitch) / 45) * 0.3 + least(1, abs(roll) / 90) * 0.1) + 1))"
SCORES_SQL = f"""{FACES_SQL}, parts as (
  select *, {line('side', 80.0, 250.0, 0.25, 1.0)} as size, {POSE.format(y='abs(yaw)')} as pose, {POSE.format(y='abs(yaw * 1.5)')} as facing,
    {line('(case when pred = 0 then prob else -prob end)', -1.0, 1.0, 0.25, 1.0)} as raw, coalesce(sharp, 0.25) as sharpness from faces),
scores as (select *, facing * raw + (1 - facing) * 0.625 as occlusion, least(greatest(size * 0.35 + pose * 0.30 + (facing * raw + (1 - facing) * 0.625) * 0.10 + sharpness * 0.25, 0), 1) as composite from parts)
"""


def faces(spark, sf_dir):
    sharp = F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 10)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("face"), (F.col("l_quantity") * 8).cast("long").alias("side"), (F.col("l_partkey") % 121 - 60.0).alias("yaw"), (F.col("l_suppkey") % 91 - 45.0).alias("pitch"), (F.col("l_orderkey") % 181 - 90.0).alias("roll"), (F.col("l_linenumber") % 2).alias("pred"), (F.col("l_discount") * 10).alias("prob"), sharp.alias("sharp"), F.col("l_orderkey").alias("job"), "l_linenumber")


def scored(spark, sf_dir):
    f = faces(spark, sf_dir)
    return f.withColumn("q", q.face_quality(*(F.col(c) for c in ("side", "yaw", "pitch", "roll", "pred", "prob", "sharp")))).select("*", "q.*")


@query("quality_composite", f"""with {SCORES_SQL}
select face, round(size, 6) as size, round(pose, 6) as pose, round(occlusion, 6) as occlusion, round(sharpness, 6) as sharpness, round(composite, 6) as composite from scores""")
def quality_composite(spark, sf_dir):
    return scored(spark, sf_dir).select("face", *(F.round(c, 6).alias(c) for c in ("size", "pose", "occlusion", "sharpness", "composite")))


@query("quality_linear", f"""with {SCORES_SQL}
select face, round(least(greatest(0.35 * size + 0.20 * (({line('abs(yaw)', 0.0, 45.0, 1.0, 0.25)}) + ({line('abs(pitch)', 0.0, 35.0, 1.0, 0.25)})) / 2 + 0.20 * raw + 0.25 * sharpness, 0), 1), 6) as quality from scores""")
def quality_linear(spark, sf_dir):
    f = faces(spark, sf_dir)
    total = q.linear_quality(q.size_score(F.col("side")), q.linear_pose_score(F.col("yaw"), F.col("pitch")), q.raw_occlusion_score(F.col("pred"), F.col("prob")), F.coalesce("sharp", F.lit(0.25)))
    return f.select("face", F.round(total, 6).alias("quality"))


@query("quality_filter", f"""with {SCORES_SQL}
select pred, count(*) as n_faces, count(*) filter (where prob >= 0.5 and composite >= 0.4) as n_kept from scores group by pred""")
def quality_filter(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.col("pred").cast("int").alias("pred")).agg(F.count("*").alias("n_faces"), F.count_if((F.col("prob") >= 0.5) & (F.col("composite") >= 0.4)).alias("n_kept"))


@query("pose_bucket", f"""with {FACES_SQL}
select case when abs(yaw) < 15 and abs(roll) < 15 then 'front' when abs(yaw) < 15 and roll < -15 then 'front-rotate-left' when abs(yaw) < 15 and roll > 15 then 'front-rotate-right' when yaw < -15 then 'left' else 'right' end as pose,
  count(*) as n_faces, min(face) as first_face from faces group by 1""")
def pose_bucket(spark, sf_dir):
    return faces(spark, sf_dir).groupBy(q.pose_bucket(F.col("yaw"), F.col("roll")).alias("pose")).agg(F.count("*").alias("n_faces"), F.min("face").alias("first_face"))


MARKS_SQL = "marks as (select p_partkey, 40.0 as lx, 50.0 as ly, 40.0 + p_size as rx, 50.0 + p_partkey % 41 - 20 as ry, 40.0 + p_partkey % 60 as nx, 60.0 as mx, 60.0 + p_partkey % 70 as my from part)"


def marks(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.lit(40.0).alias("lx"), F.lit(50.0).alias("ly"), (F.col("p_size") + 40.0).alias("rx"), (k % 41 + 30.0).alias("ry"), (k % 60 + 40.0).alias("nx"), F.lit(60.0).alias("mx"), (k % 70 + 60.0).alias("my"))


@query("pose_geometric", f"""with {MARKS_SQL}
select p_partkey, case when abs(a) < 15 then case when abs(o) < d * 0.1 then 'front' when o > 0 then 'right' else 'left' end when a > 15 then 'front-rotate-right' else 'front-rotate-left' end as pose
from (select *, degrees(atan2(ry - ly, rx - lx)) as a, nx - (lx + rx) / 2 as o, sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)) as d from marks)""")
def pose_geometric(spark, sf_dir):
    return marks(spark, sf_dir).select("p_partkey", q.geometric_pose(*(F.col(c) for c in ("lx", "ly", "rx", "ry", "nx"))).alias("pose"))


@query("landmark_angles", f"""with {MARKS_SQL}
select p_partkey, round(case when abs(a) < 15 then degrees(atan2(nx - (lx + rx) / 2, d)) * 2 else 0 end, 6) as yaw,
  round(case when abs(a) < 15 then (sqrt(pow(mx - (lx + rx) / 2, 2) + pow(my - (ly + ry) / 2, 2)) / d - 0.7) * 50 else 0 end, 6) as pitch, round(case when abs(a) < 15 then a else 0 end, 6) as roll
from (select *, degrees(atan2(ry - ly, rx - lx)) as a, sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)) as d from marks)""")
def landmark_angles(spark, sf_dir):
    a = q.landmark_angles(*(F.col(c) for c in ("lx", "ly", "rx", "ry", "nx", "mx", "my")))
    return marks(spark, sf_dir).withColumn("a", a).select("p_partkey", *(F.round(f"a.{c}", 6).alias(c) for c in ("yaw", "pitch", "roll")))


@query("enhance_gate", f"""with {SCORES_SQL}
select face from scores where ((size >= 0.25 and size < 0.5 and sharpness >= 0.25 and pose >= 0.5) or (composite < 0.55 and sharpness >= 0.25 and pose >= 0.5)) and composite >= 0.3 and prob >= 0.2 and side * side <= 2073600""")
def enhance_gate(spark, sf_dir):
    s = scored(spark, sf_dir)
    gate = q.should_enhance(F.col("size"), F.col("sharpness"), F.col("pose"), F.col("composite"), F.col("prob"), F.col("side") * F.col("side"), trigger=0.55, min_quality=0.3, min_confidence=0.2)
    return s.where(gate).select("face")


@query("enhanced_wins", f"""with {SCORES_SQL}
select face, coalesce(prob > 0.6 and sharp > composite, false) as use_enhanced from scores""")
def enhanced_wins(spark, sf_dir):
    return scored(spark, sf_dir).select("face", q.use_enhanced(F.col("prob"), F.col("sharp"), F.col("composite")).alias("use_enhanced"))


@query("detector_route", """
select p_partkey, case when least(p_size * 60, p_partkey) < 500 then 320 when least(p_size * 60, p_partkey) < 1500 then 640 else 1024 end as det_size from part""")
def detector_route(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", q.detector_size(F.col("p_size") * 60, F.col("p_partkey")).alias("det_size"))


@query("redetect_gate", """
select l_orderkey, case when n > 0 and ok * 1.0 / n < 0.5 then coalesce(ok640 * 1.0 / nullif(n640, 0), 0) > ok * 1.0 / n else false end as retried_wins from (
  select l_orderkey, count(*) as n, count(*) filter (where l_discount > 0.04) as ok, count(*) filter (where l_linenumber > 1) as n640, count(*) filter (where l_linenumber > 1 and l_tax > 0.03) as ok640 from lineitem group by l_orderkey)""")
def redetect_gate(spark, sf_dir):
    c = lambda x: F.count_if(x)
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), c(F.col("l_discount") > 0.04).alias("ok"), c(F.col("l_linenumber") > 1).alias("n640"), c((F.col("l_linenumber") > 1) & (F.col("l_tax") > 0.03)).alias("ok640"))
    again = q.redetect(F.col("ok"), F.col("n"), F.lit(1024))
    return g.select("l_orderkey", (again & q.keep_redetection(F.col("ok"), F.col("n"), F.col("ok640"), F.col("n640"))).alias("retried_wins"))


@query("frame_quality", """
select event_id, round(s, 6) as score, case when s >= 0.7 then 'excellent' when s >= 0.5 then 'good' when s >= 0.3 then 'fair' else 'poor' end as class from (
  select event_id, round(least(value * 3 / 1000, 1) * 0.7 + least(event_id % 200 / 128.0, 1) * 0.2 + (1 - abs(event_id % 256 / 255.0 - 0.5) * 2) * 0.1, 9) as s from events)""")
def frame_quality(spark, sf_dir):
    s = F.round(q.frame_quality(F.col("value") * 3, F.col("event_id") % 200, F.col("event_id") % 256), 9)
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", F.round("s", 6).alias("score"), q.quality_class(F.col("s")).alias("class"))


@query("laplacian_sharpness", """
select event_id, round(least(greatest((value - 50) / 200, 0), 1), 6) as sharpness from events""")
def laplacian_sharpness(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(q.laplacian_sharpness(F.col("value")), 6).alias("sharpness"))


@query("pixel_statistics", """
select user_id as frame, round(var_pop(value), 3) as variance, round(stddev_pop(value), 4) as std, round(avg(value), 4) as mean from events group by user_id""")
def pixel_statistics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("frame")).agg(F.round(F.var_pop("value"), 3).alias("variance"), F.round(F.stddev_pop("value"), 4).alias("std"), F.round(F.avg("value"), 4).alias("mean"))


@query("occlusion_softmax", """
select l_orderkey * 8 + l_linenumber as face, cast(l_tax > l_discount as integer) as label, round(1 / (1 + exp(-abs(l_tax - l_discount))), 9) as probability from lineitem""")
def occlusion_softmax(spark, sf_dir):
    s = v.softmax2(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("face"), s["label"].alias("label"), F.round(s["probability"], 9).alias("probability"))


E_SQL = "e as (select vec_id, label, embedding::double[] as v from embeddings)"
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query("vector_normalise", f"""with {E_SQL}
select vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) as total, round(sqrt(list_dot_product(v, v)), 6) as norm from e""")
def vector_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.aggregate(v.l2_normalise(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(v.norm(F.col("embedding")), 6).alias("norm"))


@query("best_match", f"""with {E_SQL}
select query_id, arg_max(candidate_id, struct_pack(s := s, o := -candidate_id)) as candidate_id, round(max(s), 6) as similarity from (
  select a.vec_id as query_id, b.vec_id as candidate_id, {COS.format(a='a.v', b='b.v')} as s from e a join e b on a.label = b.label and a.vec_id % 50 = 0 and b.vec_id % 50 <> 0) where s > 0.1 group by query_id""")
def best_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    others = e.where("vec_id % 50 <> 0").select("label", F.col("vec_id").alias("candidate_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return clusters.best_matches(asked, others, "label", 0.1).withColumn("similarity", F.round("similarity", 6))


def tag_vectors(spark, sf_dir):
    """A tag for each label: the element-wise mean of its members (a row for each label)."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("tag"))


TAGS_SQL = f"{E_SQL}, tags as (select label as tag_id, list(x order by i) as t from (select label, i, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by label, i) group by label)"


@query("scene_tag_scores", f"""with {TAGS_SQL}, sims as (select vec_id, label, tag_id, {COS.format(a='v', b='t')} as c from e cross join tags),
best as (select label as scene, tag_id, max(c) as f from sims group by 1, 2), own as (select a.tag_id as scene, b.tag_id, {COS.format(a='a.t', b='b.t')} as c from tags a cross join tags b)
select own.scene, own.tag_id, round(1 / (1 + exp(-(g * own.c * tt + (1 - g) * best.f * tt))), 6) as score from own join best using (scene, tag_id), (select 1 / (1 + exp(-0.4)) as g, exp(least(2.0, 2.65)) as tt)""")
def scene_tag_scores(spark, sf_dir):
    tags = tag_vectors(spark, sf_dir)
    names = tags.select(F.col("label").alias("tag_id"), F.col("tag").alias("t"))
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scene"), "embedding")
    frames = best_similarities(e, names, ["scene"]).withColumnRenamed("best", "f")
    scene = best_similarities(tags.select(F.col("label").alias("scene"), F.col("tag").alias("embedding")), names, ["scene"]).withColumnRenamed("best", "c")
    return scene.join(frames, ["scene", "tag_id"]).select("scene", "tag_id", F.round(v.scene_tag_score(F.col("c"), F.col("f"), 0.4, 2.0), 6).alias("score"))


@query("nearest_label", f"""with {TAGS_SQL}
select vec_id, arg_max(tag_id, struct_pack(s := round({COS.format(a='v', b='t')}, 9), o := -tag_id)) as nearest from e cross join tags group by vec_id""")
def nearest_label(spark, sf_dir):
    names = tag_vectors(spark, sf_dir).select(F.col("label").alias("tag_id"), F.col("tag").alias("t"))
    return best_tags(table(spark, sf_dir, "embeddings"), names).select("vec_id", F.col("best_tag").alias("nearest"))


@query("longest_path_vector", f"""with {E_SQL}
select label, arg_max(vec_id, struct_pack(n := round(sqrt(list_dot_product(v, v)), 9), o := -vec_id)) as vec_id from e group by label""")
def longest_path_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("n", F.round(v.norm(F.col("embedding")), 9))
    return e.groupBy("label").agg(F.max_by("vec_id", F.struct("n", -F.col("vec_id"))).alias("vec_id"))


@query("mean_bias", f"""with {TAGS_SQL}, placed as (select tag_id, unnest(t) as x, generate_subscripts(t, 1) as i from tags),
bias as (select a.tag_id, b.i, avg(b.x) as x from tags a join placed b on b.tag_id % 4 = a.tag_id % 4 group by 1, 2),
added as (select tag_id, list(p.x + b.x order by i) as v from placed p join bias b using (tag_id, i) group by tag_id)
select tag_id, round(list_sum(v) / sqrt(list_dot_product(v, v)), 6) as total, len(v) as dims from added""")
def mean_bias(spark, sf_dir):
    tags = tag_vectors(spark, sf_dir)  # a tag's families: the tags of its number modulo 4
    families = tags.select((F.col("label") % 4).alias("family"), F.col("tag").alias("bias"))
    biases = tags.withColumn("family", F.col("label") % 4).join(families, "family").groupBy("label").agg(F.first("tag").alias("tag"), F.collect_list("bias").alias("biases"))
    biased = biases.select("label", v.with_mean_bias(F.col("tag"), F.col("biases")).alias("tag"))
    return biased.select(F.col("label").alias("tag_id"), F.round(F.aggregate("tag", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("tag").cast("long").alias("dims"))


def clustered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "job")
    return e, clusters.leader_clusters(e, "job", ["vec_id"], "embedding", threshold=0.3)


LEADERS_SQL = f"""with recursive {E_SQL}, placed as (select label as job, vec_id, v, row_number() over (partition by label order by vec_id) as i from e),
walk(job, i, vec_id, cluster, leaders) as (
  select distinct job, 0, cast(null as bigint), cast(null as bigint), cast([] as double[][]) from placed
  union all select job, i, vec_id, cast(coalesce(hit - 1, len(leaders)) as bigint), case when hit is null then list_append(leaders, v) else leaders end from (
    select p.*, w.leaders, nullif(coalesce(list_position(list_transform(w.leaders, lambda u: {COS.format(a='u', b='p.v')} >= 0.3), true), 0), 0) as hit from walk w join placed p on p.job = w.job and p.i = w.i + 1)),
members as (select job, vec_id, cluster from walk where i > 0)
"""


@query("leader_cluster", f"{LEADERS_SQL} select job, vec_id, cluster from members")
def leader_cluster(spark, sf_dir):
    return clustered(spark, sf_dir)[1]


@query("cluster_representative", f"""{LEADERS_SQL}
select job, cluster, arg_max(vec_id, struct_pack(q := vec_id * 37 % 101, o := -vec_id)) as vec_id, max(cast(vec_id * 37 % 101 as double)) as quality, count(*) as n_members from members group by job, cluster""")
def cluster_representative(spark, sf_dir):
    members = clustered(spark, sf_dir)[1].withColumn("quality", (F.col("vec_id") * 37 % 101).cast("double"))
    return clusters.representatives(members, ["job", "cluster"], "quality", "vec_id", [])


@query("cluster_report", f"""{LEADERS_SQL}
select job, count(distinct cluster) as unique_faces, count(*) as total_detections, count(distinct vec_id % 40) as frames_processed from members group by job""")
def cluster_report(spark, sf_dir):
    members = clustered(spark, sf_dir)[1].withColumn("frame", F.col("vec_id") % 40)
    return clusters.face_report(members, "job", "frame")


@query("one_cluster_each", """
select label as job, vec_id, row_number() over (partition by label order by vec_id) - 1 as cluster from embeddings""")
def one_cluster_each(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("job"), "vec_id")
    return clusters.one_each(e, "job", ["vec_id"]).withColumn("cluster", F.col("cluster").cast("long"))


@query("representative_face", f"""with {SCORES_SQL}
select face // 8 as job, arg_max(face, struct_pack(q := round(composite, 9), o := -face)) as face, count(*) as n_members from scores group by 1""")
def representative_face(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("quality", F.round("composite", 9))
    return clusters.representatives(s, ["job"], "quality", "face", []).select("job", "face", "n_members")


@query("detection_report", f"""with {SCORES_SQL}
select face // 8 as job, count(*) as n_detections, round(min(composite), 6) as worst, round(max(composite), 6) as best, round(avg(composite), 6) as mean from scores group by 1""")
def detection_report(spark, sf_dir):
    c = F.col("composite")
    return scored(spark, sf_dir).groupBy("job").agg(F.count("*").alias("n_detections"), F.round(F.min(c), 6).alias("worst"), F.round(F.max(c), 6).alias("best"), F.round(F.avg(c), 6).alias("mean"))


@query("detections_fallback", """
select o_custkey as job, cast(sum(coalesce(n, 1)) as bigint) as n_detections from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'A' group by 1) on l_orderkey = o_orderkey group by 1""")
def detections_fallback(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("detections"))
    own = F.when(F.col("detections").isNull(), 1).otherwise(F.size("detections"))
    return table(spark, sf_dir, "orders").join(lists, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("job")).agg(F.sum(own).alias("n_detections"))


BOXES_SQL = "truth as (select l_orderkey as frame, l_orderkey * 8 + l_linenumber as id, l_partkey % 40 as x from lineitem where l_linenumber <= 2), found as (select l_orderkey as frame, l_orderkey * 8 + l_linenumber as id, l_partkey % 40 as x from lineitem where l_linenumber between 2 and 3)"


@query("precision_recall", f"""with {BOXES_SQL}, met as (select count(distinct t.id) as m from truth t join found f on t.frame = f.frame and greatest(20 - abs(t.x - f.x), 0) * 20.0 / (800 - greatest(20 - abs(t.x - f.x), 0) * 20) > 0.7)
select (select count(*) from truth) as n_truth, (select count(*) from found) as n_found, m as n_matched, round(m * 1.0 / (select count(*) from found), 6) as "precision", round(m * 1.0 / (select count(*) from truth), 6) as recall from met""")
def precision_recall(spark, sf_dir):
    box = lambda x: (F.col(x), F.lit(0), F.col(x) + 20, F.lit(20))
    li = table(spark, sf_dir, "lineitem").withColumn("frame", F.col("l_orderkey")).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("x", F.col("l_partkey") % 40)
    truth = li.where("l_linenumber <= 2").select("frame", F.col("id").alias("truth_id"), F.col("x").alias("tx"))
    found = li.where("l_linenumber between 2 and 3").select("frame", F.col("id").alias("found_id"), F.col("x").alias("fx"))
    got = clusters.match_truth(truth, found, ["frame"], iv.iou(box("tx"), box("fx")) > 0.7)
    return got.select("n_truth", "n_found", "n_matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
