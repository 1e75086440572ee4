"""Scenes, frames, sampling times and sprite cues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import spans
from ..operators.ordered import kept_apart
from ..sources import vtt
from .base import query, seconds, table

FRAMES_SQL = "frames as (select user_id as job_id, event_id as frame_index, epoch_us(ts) / 1000000 as t, value as score from events)"
SCENES_SQL = """scenes as (
  select job_id, scene, min(t) as start, max(t) as "end", count(*) as n_frames from (
    select *, sum(case when n = 1 or score >= 400 then 1 else 0 end) over (partition by job_id order by t, frame_index rows unbounded preceding) - 1 as scene
    from (select *, row_number() over (partition by job_id order by t, frame_index) as n from frames)) group by job_id, scene)"""


def frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("frame_index"), seconds().alias("t"), F.col("value").alias("score"))


def scenes(spark, sf_dir):
    cut = spans.islands(frames(spark, sf_dir), "job_id", ["t", "frame_index"], F.col("score") >= 400)
    return cut, spans.scenes_of(cut, "job_id", "t")


@query("scene_islands", f"""with {FRAMES_SQL}, {SCENES_SQL}
select job_id, cast(scene as bigint) as scene, start, "end", n_frames, round("end" - start, 6) as duration from scenes""")
def scene_islands(spark, sf_dir):
    return scenes(spark, sf_dir)[1].withColumn("duration", F.round("duration", 6))


@query("mean_scene_duration", f"""with {FRAMES_SQL}, {SCENES_SQL}
select job_id, count(*) as n_scenes, round(avg("end" - start), 3) as mean_duration from scenes group by job_id""")
def mean_scene_duration(spark, sf_dir):
    return scenes(spark, sf_dir)[1].groupBy("job_id").agg(F.count("*").alias("n_scenes"), F.round(F.avg("duration"), 3).alias("mean_duration"))


@query("default_scene", """
select c_custkey as video, coalesce(n, 1) as n_scenes, case when n is null then c_custkey - 1 end as end_frame from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey""")
def default_scene(spark, sf_dir):
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video"), F.col("c_custkey").alias("total_frames"), F.lit(10.0).alias("duration"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"), F.lit(0).cast("long").alias("scene"), F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    return spans.whole_video_where_none(videos, found, "video").groupBy("video").agg(F.count("*").alias("n_scenes"), F.max("end_frame").alias("end_frame"))


@query("frames_in_scene", f"""with {FRAMES_SQL}, {SCENES_SQL}
select s.job_id, cast(s.scene as bigint) as scene, count(*) as n_frames from scenes s join frames f on f.job_id = s.job_id and f.t between s.start and s."end" + 3600 group by s.job_id, s.scene""")
def frames_in_scene(spark, sf_dir):
    found = scenes(spark, sf_dir)[1].select("job_id", "scene", "start", (F.col("end") + 3600).alias("end"))
    met = spans.points_in_spans(frames(spark, sf_dir), found, "job_id", "t", 86_400.0)
    return met.groupBy("job_id", "scene").agg(F.count("*").alias("n_frames"))


@query("frames_in_open_scenes", f"""with {FRAMES_SQL}, {SCENES_SQL}
select s.job_id, cast(s.scene as bigint) as scene, count(*) as n_frames, max(f.t) as last_t from (select *, scene % 3 = 0 as is_open from scenes) s
join frames f on f.job_id = s.job_id and f.t >= s.start and (s.is_open or f.t < s."end") group by s.job_id, s.scene""")
def frames_in_open_scenes(spark, sf_dir):
    """Every third scene of a job has no end yet."""
    found = scenes(spark, sf_dir)[1].select("job_id", "scene", "start", F.when(F.col("scene") % 3 != 0, F.col("end")).alias("end"))
    met = spans.points_in_spans(frames(spark, sf_dir), found, "job_id", "t", 86_400.0, closed=False)
    return met.groupBy("job_id", "scene").agg(F.count("*").alias("n_frames"), F.max("t").alias("last_t"))


@query("topn_per_scene", f"""with {FRAMES_SQL}
select job_id, frame_index, rank from (select *, row_number() over (partition by job_id order by score desc, frame_index) as rank from frames where score >= 24.5) where rank <= 3""")
def topn_per_scene(spark, sf_dir):
    return spans.top_n(frames(spark, sf_dir), ["job_id"], "score", ["frame_index"], 3, least=24.5).select("job_id", "frame_index", F.col("rank").cast("long").alias("rank"))


@query("even_thin", f"""with {FRAMES_SQL}, placed as (select *, row_number() over (partition by job_id order by t, frame_index) - 1 as pos, count(*) over (partition by job_id) as n from frames)
select job_id, frame_index from placed where n <= 22 or pos in (select cast(floor(i * (n / 22.0)) as bigint) from range(22) r(i))""")
def even_thin(spark, sf_dir):
    return spans.thin(frames(spark, sf_dir), "job_id", ["t", "frame_index"], 22).select("job_id", "frame_index")


@query("resample16", f"""with {FRAMES_SQL}, placed as (select job_id, frame_index, row_number() over (partition by job_id order by t, frame_index) - 1 as pos, count(*) over (partition by job_id) as n from frames)
select p.job_id, r.i as place, p.frame_index from placed p join (select unnest(range(16)) as i) r on p.pos = case when p.n >= 16 then (r.i * (p.n - 1)) // 15 else least(r.i, p.n - 1) end""")
def resample16(spark, sf_dir):
    lists = frames(spark, sf_dir).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "frame_index"))), lambda x: x["frame_index"]).alias("f"))
    return lists.select("job_id", F.posexplode(iv.resample16(F.col("f"))).alias("place", "frame_index")).select("job_id", F.col("place").cast("long").alias("place"), "frame_index")


@query("keep_selected_frames", f"""with {FRAMES_SQL}
select f.job_id, f.frame_index, f.score as frame_score, s.pick from frames f join (select event_id, event_id % 7 as pick from events where event_id % 5 = 0) s on s.event_id = f.frame_index""")
def keep_selected_frames(spark, sf_dir):
    chosen = table(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("frame_index"), (F.col("event_id") % 7).alias("pick"))
    return spans.keep_selected(frames(spark, sf_dir), chosen, ["frame_index"]).select("job_id", "frame_index", F.col("score").alias("frame_score"), "pick")


ENTRIES_SQL = "entries as (select user_id as job_id, epoch_us(ts) / 1000000 as start, epoch_us(ts) / 1000000 + 900 as \"end\", event_id as ord from events where event_type = 'view'), asked as (select user_id as job_id, epoch_us(ts) / 1000000 as t, event_id as frame_index from events where event_type = 'click')"


def entries(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", seconds()).withColumnRenamed("user_id", "job_id")
    return e.where("event_type = 'view'").select("job_id", F.col("t").alias("start"), (F.col("t") + 900).alias("end"), F.col("event_id").alias("ord")), e.where("event_type = 'click'").select("job_id", "t", F.col("event_id").alias("frame_index"))


@query("nearest_entry", f"""with {ENTRIES_SQL}
select frame_index, arg_min(ord, struct_pack(k := case when t >= start and t < "end" and start = last then 0 else 1 end, d := abs(start - t), o := ord)) as entry_ord from (
  select a.*, e.*, max(case when e.start <= a.t then e.start end) over (partition by a.frame_index) as last from asked a join entries e using (job_id)) group by frame_index""")
def nearest_entry(spark, sf_dir):
    cues, asked = entries(spark, sf_dir)
    found = spans.nearest_start(asked, cues, "job_id", ["frame_index"], "t")
    return found.where("entry_ord is not null").select("frame_index", "entry_ord")


@query("nearest_frame", f"""with {ENTRIES_SQL}
select frame_index, min(abs(start - t)) as distance from asked join entries using (job_id) group by frame_index""")
def nearest_frame(spark, sf_dir):
    shots, asked = entries(spark, sf_dir)
    found = spans.nearest_start(asked, shots.withColumn("end", F.col("start")), "job_id", ["frame_index"], "t")
    return found.where("entry_start is not null").select("frame_index", F.abs(F.col("entry_start") - F.col("t")).alias("distance"))


@query("sample_timestamps", """
with recursive steps(step, i, t) as (select unnest([2.0::double, 0.1::double]), 0, 0.0::double union all select step, i + 1, t + step from steps where i < 2000)
select video, cast(i as bigint) as place, round(least(t, d - 0.1), 6) as t from (select o_orderkey as video, floor(o_totalprice) / 10000 as d, case when o_orderkey % 40 = 1 then 0.1 else 2.0 end::double as own from orders) join steps on step = own and t < d""")
def sample_timestamps(spark, sf_dir):
    videos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), (F.floor("o_totalprice") / 10000).alias("d"), F.when(F.col("o_orderkey") % 40 == 1, 0.1).otherwise(2.0).alias("step"))
    times = videos.select("video", F.posexplode(iv.interval_times(F.col("d"), F.col("step"))).alias("place", "t"))
    return times.select("video", F.col("place").cast("long").alias("place"), F.round("t", 6).alias("t"))


@query("scene_timestamps", """
select o_orderkey as video, round(least(a + (b - a) * q, d - 0.1), 6) as t from (
  select o_orderkey, o_orderkey % 50 * 1.0 as a, o_orderkey % 50 + 7.0 as b, 40.0 as d from orders), (select unnest([0.25, 0.5, 0.75]) as q) where a + (b - a) * q < d""")
def scene_timestamps(spark, sf_dir):
    a = (F.col("o_orderkey") % 50).cast("double")
    times = iv.scene_times(F.array(a), F.array(a + 7.0), F.lit(40.0))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), F.explode(times).alias("t")).withColumn("t", F.round("t", 6))


@query("scene_candidates", """
select distinct o_orderkey as scene, round(case when n = 1 then a + l / 2 when n = 2 then case when i = 0 then a + l * 0.1 else a + l * 0.9 end else a + l * ((i + 0.5) / n) end, 6) as t
from (select o_orderkey, 1 + o_orderkey % 6 as n, (o_orderkey % 90)::double as a, (o_orderkey % 13)::double as l from orders), (select unnest(range(6)) as i) where i < n""")
def scene_candidates(spark, sf_dir):
    a, n = (F.col("o_orderkey") % 90).cast("double"), (1 + F.col("o_orderkey") % 6).cast("int")
    times = iv.sorted_unique(F.transform(iv.scene_candidates(a, a + F.col("o_orderkey") % 13, n), lambda t: F.round(t, 6)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene"), F.explode(times).alias("t"))


@query("adaptive_step", """
select o_orderkey as video, round(d, 6) as duration, round(case when d < 20 and greatest(d / 20, 0.1) < 2 then greatest(d / 20, 0.1) else 2.0 end, 6) as step,
  case when d > 0 then greatest(1, cast(floor(d / 3) as bigint)) else 0 end as n_scenes, cast(floor(d / 2.0) as bigint) as n_frames
from (select o_orderkey, case when o_orderkey % 9 = 0 then 0 else (o_orderkey % 1000) / 25.0 end as d from orders)""")
def adaptive_step(spark, sf_dir):
    fps = F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(25.0)
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), iv.duration_of(F.col("o_orderkey") % 1000, fps).alias("duration"))
    return v.select("video", F.round("duration", 6).alias("duration"), F.round(iv.adaptive_step(F.col("duration"), F.lit(2.0)), 6).alias("step"), iv.estimated_scenes(F.col("duration")).alias("n_scenes"), iv.estimated_frames(F.col("duration"), F.lit(2.0)).alias("n_frames"))


@query("timeline_geometry", f"""with {FRAMES_SQL}, {SCENES_SQL}, total as (select job_id, min(start) as a, max("end") as b from scenes group by job_id)
select s.job_id, cast(scene as bigint) as scene, round((start - a) * 100 / (b - a), 6) as left_percent, round(("end" - start) * 100 / (b - a), 6) as width_percent from scenes s join total using (job_id) where b > a""")
def timeline_geometry(spark, sf_dir):
    found = scenes(spark, sf_dir)[1]
    w = Window.partitionBy("job_id")
    a, b = F.min("start").over(w), F.max("end").over(w)
    rows = found.withColumn("a", a).withColumn("total", b - a).where("total > 0")
    return rows.select("job_id", "scene", F.round((F.col("start") - F.col("a")) * 100 / F.col("total"), 6).alias("left_percent"), F.round(F.col("duration") * 100 / F.col("total"), 6).alias("width_percent"))


@query("overlay_contain", """
select p_partkey, round(w / width, 6) as scale_x, round(h / height, 6) as scale_y, round((640 - w) / 2, 6) as offset_x, round((360 - h) / 2, 6) as offset_y from (
  select p_partkey, width, height, case when width / height > 640 / 360.0 then 640.0 else 360 * (width / height) end as w, case when width / height > 640 / 360.0 then 640 / (width / height) else 360.0 end as h
  from (select p_partkey, (p_size * 10 + 100)::double as width, (p_partkey % 50 * 10 + 100)::double as height from part))""")
def overlay_contain(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10 + 100).cast("double").alias("w"), (F.col("p_partkey") % 50 * 10 + 100).cast("double").alias("h"))
    c = iv.contain(F.lit(640.0), F.lit(360.0), F.col("w"), F.col("h"))
    return p.select("p_partkey", *(F.round(c[n], 6).alias(n) for n in ("scale_x", "scale_y", "offset_x", "offset_y")))


CUES_SQL = "cues as (select user_id as job_id, event_id, event_id % 359999 as s, row_number() over (partition by user_id order by event_id) as n from events)"


def cue_texts(spark, sf_dir):
    """A WebVTT text for each user, written from its events; every 13th block has no box."""
    s = F.col("event_id") % 359_999
    clock = lambda t: F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (F.floor(t / 3600), F.floor(t % 3600 / 60))), F.concat(F.lpad((t % 60).cast("string"), 2, "0"), F.lit(".250")))
    box = F.when(F.col("event_id") % 13 == 0, F.lit("sprite.jpg")).otherwise(F.concat(F.lit("sprite.jpg#xywh="), F.col("event_id") % 5 * 160, F.lit(",90,160,"), F.col("event_id") % 3 * 45))
    block = F.concat(clock(s), F.lit(" --> "), clock(s + 1), F.lit("\n"), box)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.struct("event_id", block.alias("block")).alias("b"))
    lists = e.groupBy("job_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return lists.select("job_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("bs", lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("vtt"))


@query("vtt_strict", f"""with {CUES_SQL}
select job_id, cast(n as bigint) as ord, s + 0.25::double as start, s + 1.25::double as "end", cast(event_id % 5 * 160 as integer) as x, 90 as y, 160 as w, cast(event_id % 3 * 45 as integer) as h from cues where event_id % 13 <> 0""")
def vtt_strict(spark, sf_dir):
    return vtt.strict_cues(cue_texts(spark, sf_dir), "job_id").withColumn("ord", F.col("ord").cast("long"))


@query("vtt_loose", f"""with {CUES_SQL}
select job_id, s + 0.25::double as start, s + 1.25::double as "end", cast(event_id % 5 * 160 as integer) as x, 90 as y, 160 as w, cast(event_id % 3 * 45 as integer) as h from cues where event_id % 13 <> 0""")
def vtt_loose(spark, sf_dir):
    return vtt.loose_cues(cue_texts(spark, sf_dir), "job_id").drop("ord")


@query("vtt_tiles", f"""with {CUES_SQL}
select job_id, s + 0.75::double as timestamp from cues where event_id % 13 <> 0 and event_id % 3 <> 0""")
def vtt_tiles(spark, sf_dir):
    return vtt.tile_times(vtt.strict_cues(cue_texts(spark, sf_dir), "job_id")).select("job_id", "timestamp")


@query("extraction_success", """
select user_id as job_id, round(count(*) filter (where event_type <> 'error') * 1.0 / count(*), 6) as success_ratio, cast(sum(case when event_id % 2 = 0 then event_id % 4 end) as bigint) as n_enhanced from events group by user_id""")
def extraction_success(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok, enhanced = F.count_if(F.col("event_type") != "error") / F.count("*"), F.sum(F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 4))
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.round(ok, 6).alias("success_ratio"), enhanced.alias("n_enhanced"))


MARKS_SQL = """marks as (select *, row_number() over (partition by method, job_id order by t, frame_index) as i from marked where hit),
kept(method, job_id, t, frame_index) as (
  select method, job_id, t, frame_index from marks where i = 1
  union all select method, job_id, t, frame_index from (
    select m.*, row_number() over (partition by m.method, m.job_id order by m.t, m.frame_index) as nth from kept k join marks m on m.method = k.method and m.job_id = k.job_id and m.t >= k.t + 7200) where nth = 1)"""


@query("shot_boundaries", f"""with recursive {FRAMES_SQL}, near as (
  select *, lag(score) over w as before, sum(score) over (w rows between 2 preceding and 2 following) - score as around, count(*) over (w rows between 2 preceding and 2 following) - 1 as beside from frames window w as (partition by job_id order by t, frame_index)),
marked as (select job_id, frame_index, t, method, case method when 'content' then score >= 100 when 'threshold' then score >= 100 and before < 100 else beside > 0 and score * beside >= 4 * around end as hit
  from near cross join (select unnest(['content', 'threshold', 'adaptive']) as method)), {MARKS_SQL}
select method, job_id, count(*) as n_cuts, cast(sum(frame_index) as bigint) as frames from kept group by method, job_id""")
def shot_boundaries(spark, sf_dir):
    f = frames(spark, sf_dir)
    found = [spans.cuts(f, "job_id", ["t", "frame_index"], "score", "t", m, limit, 7200.0).where("cut").withColumn("method", F.lit(m)) for m, limit in (("content", 100.0), ("threshold", 100.0), ("adaptive", 4.0))]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("method", "job_id").agg(F.count("*").alias("n_cuts"), F.sum("frame_index").alias("frames"))


@query("fade_cuts", f"""with recursive {FRAMES_SQL}, lit as (select *, score >= 60 as bright, lag(score >= 60, 1, true) over (partition by job_id order by t, frame_index) as before from frames),
turns as (select *, lag(t) over (partition by job_id order by t, frame_index) as fade_out from lit where bright <> before),
marked as (select 'fade' as method, job_id, fade_out + (t - fade_out) * 0.5 as t, t as fade_in, fade_out, row_number() over (order by job_id, t) as frame_index, true as hit from turns where bright and fade_out is not null), {MARKS_SQL}
select k.job_id, round(m.fade_out, 6) as fade_out, round(m.fade_in, 6) as fade_in, round(k.t, 6) as cut_at from kept k join marked m using (job_id, frame_index)""")
def fade_cuts(spark, sf_dir):
    found = spans.fades(frames(spark, sf_dir), "job_id", ["t", "frame_index"], "score", "t", 60.0)
    kept = kept_apart(found, "job_id", ["fade_in"], "cut_at", 7200.0)
    return kept.select("job_id", *(F.round(c, 6).alias(c) for c in ("fade_out", "fade_in", "cut_at")))


@query("candidate_count", """
select o_orderkey, case when o_orderkey % 2 = 0 and o_custkey % 3 > 0 then (o_orderkey % 5 + 1) * 3 else o_orderkey % 5 + 1 end as n_frames from orders""")
def candidate_count(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", iv.candidate_count(k % 5 + 1, F.lit(3), k % 2 == 0, F.col("o_custkey") % 3 > 0).alias("n_frames"))
