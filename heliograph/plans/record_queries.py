"""Records of several shapes, overrides and switches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as ops
from ..operators import normalise
from ..sources import media, sinks
from .base import query, table


@query("scene_context_override", """
select o_orderkey as scene, case when o_orderkey % 3 = 0 then o_totalprice * 2 else o_totalprice end as duration, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'given' else o_orderstatus end as source from orders""")
def scene_context_override(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_totalprice").alias("duration"), F.col("o_orderstatus").alias("source"))
    params = o.where("scene % 3 = 0").select("scene", (F.col("duration") * 2).alias("duration"), F.when(F.col("scene") % 2 == 0, "given").otherwise("").alias("source"))
    return normalise.scene_context(o, params, "scene", ["duration"], ["source"])


@query("operation_set", """
select case when event_id % 4 in (0, 1, 2) then 'title,summary,tags' else event_type end as operations, count(*) as n from events group by 1""")
def operation_set(spark, sf_dir):
    k = F.col("event_id") % 4
    asked = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("tags"), F.lit("all"))).when(k == 3, F.array("event_type"))
    return table(spark, sf_dir, "events").groupBy(F.array_join(ops.operations(asked), ",").alias("operations")).agg(F.count("*").alias("n"))


@query("modules_enabled", """
select event_id % 2 = 0 as image, case when event_id % 2 = 0 then false else event_id % 3 = 0 or (event_id % 5 = 0 and event_id % 7 = 0) end as scenes, event_id % 5 = 0 as semantics, count(*) as n from events group by 1, 2, 3""")
def modules_enabled(spark, sf_dir):
    has = lambda n: F.col("event_id") % n == 0
    m = ops.modules_enabled(has(2), has(3), F.lit(True), has(5), F.lit(False), has(7))
    return table(spark, sf_dir, "events").groupBy(has(2).alias("image"), m["scenes"].alias("scenes"), m["semantics"].alias("semantics")).agg(F.count("*").alias("n"))


def result_docs(spark, sf_dir):
    """Results as JSON: a bare list, an object, a nested object, or neither."""
    item = lambda i: F.concat(F.lit('{"start_timestamp": '), i, F.lit("}"))
    faces = F.concat(F.lit("["), item(F.col("event_id").cast("string")), F.lit(", "), item(F.lit("2")), F.lit("]"))
    k = F.col("event_id") % 4
    doc = F.when(k == 0, faces).when(k == 1, F.concat(F.lit('{"faces": '), faces, F.lit("}"))).when(k == 2, F.concat(F.lit('{"results": {"faces": '), faces, F.lit("}}"))).otherwise(F.lit('{"other": 1}'))
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))


@query("result_normalise", """
select event_id, case when event_id % 4 = 3 then 0 else 2 end as n_items, case when event_id % 4 = 3 then null else event_id * 1.0::double end as first_start from events""")
def result_normalise(spark, sf_dir):
    items = normalise.result_items(F.col("doc"), "faces", "struct<start_timestamp:double>")
    return result_docs(spark, sf_dir).select("event_id", F.size(items).alias("n_items"), normalise.item_at(items, F.lit(0))["start_timestamp"].alias("first_start"))


@query("field_fallback", """
select event_id, case event_id % 3 when 0 then value when 1 then event_id::double else 0.0 end as start from events""")
def field_fallback(spark, sf_dir):
    k = F.col("event_id") % 3
    doc = F.when(k == 0, F.concat(F.lit('{"start_timestamp": '), F.col("value").cast("string"), F.lit("}"))).when(k == 1, F.concat(F.lit('{"start_time": '), F.col("event_id").cast("string"), F.lit("}"))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", normalise.first_field(doc, ["start_timestamp", "start_time"], "double", 0.0).alias("start"))


@query("query_parameters", """
select event_id, case when event_id % 2 = 0 then 'limit,service' else 'service' end as kept from events""")
def query_parameters(spark, sf_dir):
    params = F.create_map(F.lit("service"), F.col("event_type"), F.lit("status"), F.lit(""), F.lit("limit"), F.when(F.col("event_id") % 2 == 0, "50"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(normalise.query_parameters(params))), ",").alias("kept"))


@query("frame_by_ordinal", """
select user_id, list_extract(list(event_id order by event_id), 11) as tenth from events group by user_id""")
def frame_by_ordinal(spark, sf_dir):
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("frames"))
    return lists.select("user_id", normalise.item_at(F.col("frames"), F.lit(10)).alias("tenth"))


@query("upsert_jobs", """
select o_orderkey as job_id, case when o_orderkey % 5 = 0 then 'new' else o_orderstatus end as status from orders union all select -o_orderkey, 'new' from orders where o_orderkey % 50 = 0""")
def upsert_jobs(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    added = old.where("job_id % 50 = 0").select((-F.col("job_id")).alias("job_id"), F.lit("new").alias("status"))
    return sinks.upserted(old, old.where("job_id % 5 = 0").select("job_id", F.lit("new").alias("status")).unionByName(added), ["job_id"])


@query("missing_frames", """
select l_orderkey, l_linenumber from lineitem where l_linenumber > 2""")
def missing_frames(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    key = media.frame_cache_key(F.col("l_orderkey").cast("string"), F.col("l_linenumber"), F.lit("jpeg"), F.lit(95), F.lit(False), F.lit("none"), F.lit(0.5))
    wanted = l.select("l_orderkey", "l_linenumber", key.alias("frame_key"))
    return media.missing_frames(wanted, wanted.where("l_linenumber <= 2")).drop("frame_key")


@query("rotation_needed", """
select count(*) filter (where p_size % 9 not in (0, 1)) as n_rotated, count(*) as n from part""")
def rotation_needed(spark, sf_dir):
    tag = F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 9)
    return table(spark, sf_dir, "part").agg(F.count_if(media.needs_rotation(tag)).alias("n_rotated"), F.count("*").alias("n"))
