"""Stores, sinks and sources at work: lookups by id, expiring results, published updates, paged and JSON taxonomies, decoder chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import media, sinks, stores
from ..sources import taxonomy as tag_source
from ..streaming import jobs as streams
from .base import JOBS_SQL, jobs, query, table
from .stream_queries import event_stream


# Each event asks for the job three ids further on in its own namespace.
@query("job_lookup", f"""with {JOBS_SQL}
select a.job_id as asked_by, a.job_id + 3 as job_id, a.service, b.job_id is not null as found, b.status
from jobs a left join jobs b on b.job_id = a.job_id + 3 and b.service = a.service""")
def job_lookup(spark, sf_dir):
    j = jobs(spark, sf_dir)
    asked = j.select(F.col("job_id").alias("asked_by"), (F.col("job_id") + 3).alias("job_id"), "service")
    return stores.lookup_each(asked, j.select("job_id", "service", "status"), ["service", "job_id"]).select("asked_by", "job_id", "service", "found", F.col("row.status").alias("status"))


# Scenes are parts, with a file each but for every 11th; events ask for scenes, of which some don't exist.
@query("scene_lookup", """
select event_id as request_id, e.scene_id, p_partkey is not null as found, p_name as title, case when p_partkey % 11 <> 0 then '/media/' || p_partkey || '.mp4' end as path,
  case when p_partkey % 11 <> 0 then cast(p_size as double) end as duration
from (select event_id, nullif(event_id % 1013 * 3, 0) as scene_id from events) e left join part on p_partkey = scene_id""")
def scene_lookup(spark, sf_dir):
    file = F.struct(F.concat(F.lit("/media/"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"), F.col("p_size").cast("double").alias("duration"))
    scenes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), F.col("p_name").alias("title"), F.filter(F.array(F.when(F.col("p_partkey") % 11 != 0, file)), lambda x: x.isNotNull()).alias("files"))
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.nullif(F.col("event_id") % 1013 * 3, F.lit(0)).alias("scene_id"))
    found = stores.lookup_each(asked, scenes, ["scene_id"])
    first = F.try_element_at("row.files", F.lit(1))
    return found.select("request_id", "scene_id", "found", F.col("row.title").alias("title"), first["path"].alias("path"), first["duration"].alias("duration"))


@query("stored_results", f"""with {JOBS_SQL}
select job_id, service, status from jobs where job_id % 4 <> 0 and service in ('vision', 'faces')""")
def stored_results(spark, sf_dir):
    path = f"{shared_folder(spark, 'stored-results')}/results"
    rows = jobs(spark, sf_dir).select("job_id", "service", "status")
    sinks.write_results(rows.where("job_id % 4 <> 0"), path, 86_400)
    sinks.write_results(rows.where("job_id % 4 = 0"), path, -10)  # expired when they are read
    return stores.fresh(stores.scan(spark, path, ("vision", "faces")), F.current_timestamp()).select("job_id", "service", "status")


@query("published_updates", """
select user_id as job_id, max(event_id) as seq, arg_max(event_type, event_id) as status from events group by user_id""")
def published_updates(spark, sf_dir):
    """What subscribers hold in the end: each batch gives the latest update of each job."""
    path = shared_folder(spark, "published-updates")
    updates = event_stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    sinks.publish(updates, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/sent/batch={n}"), f"{path}/log").awaitTermination()
    return stores.dedupe_keep_first(spark.read.parquet(f"{path}/sent"), ["job_id"], [F.desc("seq")]).select("job_id", "seq", "status")


@query("paged_tags", """select 'c' || c_custkey as id, c_name as name, c_mktsegment as description from customer""")
def paged_tags(spark, sf_dir):
    """A tag service over the customers: a page is read from their file by the executor that asks for it."""
    path = f"{sf_dir}/customer.parquet"

    def fetch(page: int, size: int) -> tuple[list[dict], int]:
        import pyarrow.dataset as ds

        rows = ds.dataset(path)
        total = rows.count_rows()
        some = rows.take(range((page - 1) * size, min(page * size, total)), columns=["c_custkey", "c_name", "c_mktsegment"]).to_pylist()
        return [{"id": f"c{r['c_custkey']}", "name": r["c_name"], "description": r["c_mktsegment"]} for r in some], total

    return tag_source.paged_tags(spark, fetch, 2_000)


@query("taxonomy_payloads", """
select 'c' || c_custkey as child_id, 'n' || c_nationkey as parent_id, 0 as ord from customer union all
select 'c' || c_custkey, 'r' || c_custkey % 5, 1 from customer where c_custkey % 10 = 0 union all
select 'a' || c_custkey, 'c' || c_custkey, 1000000 from customer where c_custkey % 3 = 0""")
def taxonomy_payloads(spark, sf_dir):
    """The edges told by payloads of all three shapes, a tag each."""
    name = lambda p, c: F.struct(F.concat(F.lit(p), c.cast("string")).alias("id"), F.concat(F.lit(p), c.cast("string")).alias("name"))
    key = F.col("c_custkey")
    parents = F.filter(F.array(name("n", F.col("c_nationkey")), F.when(key % 10 == 0, name("r", key % 5))), lambda x: x.isNotNull())
    children = F.filter(F.array(F.when(key % 3 == 0, name("a", key))), lambda x: x.isNotNull())
    tags = F.to_json(F.array(F.struct(F.concat(F.lit("c"), key.cast("string")).alias("id"), F.col("c_name").alias("name"), parents.alias("parents"), children.alias("children"))))
    whole = F.concat(F.lit('{"data": {"findTags": {"tags": '), tags, F.lit("}}}"))
    payload = F.when(key % 3 == 0, tags).when(key % 3 == 1, F.concat(F.lit('{"tags": '), tags, F.lit("}"))).otherwise(whole)
    _, edges = tag_source.nodes_and_edges(tag_source.tags_of(table(spark, sf_dir, "customer").select(payload.alias("payload"))))
    return edges.select("child_id", "parent_id", "ord")


@query("decoder_chain", """
select 'p' || page_id as key, case when length(h) % 4 = 0 then 'tail' else 'head' end as decoder, case when length(h) % 4 = 0 then right(h, 32) else left(h, 32) end as image
from (select page_id, hex(encode(html)) as h from pages) where h <> ''""")
def decoder_chain(spark, sf_dir):
    """The pages' bytes through a chain of two decoders: the first takes contents of even length only."""
    chain = [("tail", lambda c, t: c[-16:] if c and len(c) % 2 == 0 else None), ("head", lambda c, t: c[:16] or None)]
    pages = table(spark, sf_dir, "pages").where("html is not null")
    videos = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.lit(0).alias("frame_index"), F.lit(0.0).alias("timestamp"), F.encode("html", "UTF-8").alias("content"))
    return media.decode_frames(videos, chain).select("key", "decoder", F.hex("image").alias("image"))
