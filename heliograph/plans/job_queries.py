"""Job listings, stores and their joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as ops
from ..operators import resources
from ..sources import stores
from .base import JOBS_SQL, jobs, query, seconds, table

SINCE, UNTIL = 1_704_500_000.0, 1_706_000_000.0
PLACE_SQL = "list_position(['vision','faces','scenes','semantics','objects','captions'], service)"


@query("job_list_page", f"""with {JOBS_SQL}
select job_id, service, status, source_id, created_s from (
  select *, coalesce(created_s, 0) as made from jobs where status = 'completed' and (created_s is null or created_s between {SINCE} and {UNTIL}))
order by made desc, {PLACE_SQL}, job_id limit 50 offset 20""")
def job_list_page(spark, sf_dir):
    found = ops.filter_jobs(jobs(spark, sf_dir), status="completed", since=SINCE, until=UNTIL)
    return ops.page(found, limit=50, offset=20).select("job_id", "service", "status", "source_id", F.when(F.col("created_at").isNotNull(), ops.created_seconds(F.col("created_at"))).alias("created_s"))


@query("job_count_by_service", f"""with {JOBS_SQL}, names as (select unnest(['vision','faces','scenes','semantics','objects','captions']) as service)
select n.service, count(j.job_id) as n_jobs from names n left join (select * from jobs where created_s is null or created_s >= {SINCE}) j on n.service = j.service group by n.service""")
def job_count_by_service(spark, sf_dir):
    return ops.count_by_service(ops.filter_jobs(jobs(spark, sf_dir), since=SINCE))


@query("job_filter_all", f"""with {JOBS_SQL}
select job_id, status from jobs where service = 'faces' and source_id = 'user-7'""")
def job_filter_all(spark, sf_dir):
    return ops.filter_jobs(jobs(spark, sf_dir), service="faces", source_id="user-7", source="events").select("job_id", "status")


@query("job_summary_defaults", f"""with {JOBS_SQL}
select job_id, service, status, case when job_id % 5 = 0 then 0.0 else progress end as progress from jobs""")
def job_summary_defaults(spark, sf_dir):
    some = jobs(spark, sf_dir).withColumn("progress", F.when(F.col("job_id") % 5 != 0, F.col("progress")))
    return ops.summary(some).select("job_id", "service", "status", "progress")


@query("job_result_status", f"""with {JOBS_SQL}
select http_status, count(*) as n_jobs from (
  select case when job_id % 7 = 0 then 404 when status <> 'completed' then 409 else 200 end as http_status from jobs) group by http_status""")
def job_result_status(spark, sf_dir):
    j = jobs(spark, sf_dir)
    state = F.when(F.col("job_id") % 7 != 0, F.col("status"))
    return j.select(ops.result_status(state).alias("http_status")).groupBy("http_status").agg(F.count("*").alias("n_jobs"))


@query("job_results_join", """
select o.o_orderkey as job_id, case when o.o_orderkey % 2 = 0 then 'scenes' else 'semantics' end as service,
  case when r.n is null then 'none' when o.o_orderkey % 2 = 0 then cast(r.n as varchar) else 'completed' end as result_summary
from orders o left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by l_orderkey) r on o.o_orderkey = r.l_orderkey""")
def job_results_join(spark, sf_dir):
    service = F.when(F.col("job_id") % 2 == 0, "scenes").otherwise("semantics")
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")).withColumn("service", service)
    results = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n")).withColumn("service", service)
    return ops.with_results(j, results).select("job_id", "service", F.when(F.col("n").isNull(), "none").otherwise(ops.result_summary(F.col("service"), F.col("n"))).alias("result_summary"))


@query("job_status_enrichment", f"""with {JOBS_SQL}
select j.job_id, j.status, case when j.status = 'completed' then coalesce(c.n, 0) end as n_items
from jobs j left join (select o_orderkey, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey) c on c.o_orderkey = j.job_id""")
def job_status_enrichment(spark, sf_dir):
    items = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("job_id")).agg(F.count("*").alias("n"))
    return jobs(spark, sf_dir).join(items, "job_id", "left").select("job_id", "status", F.when(F.col("status") == "completed", F.coalesce("n", F.lit(0))).alias("n_items"))


@query("job_latest_status", f"""with {JOBS_SQL}
select source_id, arg_max(status, struct_pack(s := coalesce(created_s, 0), j := job_id)) as status, arg_max(job_id, struct_pack(s := coalesce(created_s, 0), j := job_id)) as job_id,
  arg_max(case when status <> 'processing' then status end, struct_pack(s := coalesce(created_s, 0), j := job_id)) filter (where status <> 'processing') as last_end
from jobs group by source_id""")
def job_latest_status(spark, sf_dir):
    log = jobs(spark, sf_dir).withColumn("at", ops.created_seconds(F.col("created_at"))).withColumn("last_end", F.when(F.col("status") != "processing", F.col("status")).otherwise(""))
    return stores.fold_updates(log, "source_id", ["at", "job_id"], sticky=["last_end"], last=["status", "job_id"])


@query("job_first_hit", f"""with {JOBS_SQL}
select source_id, arg_min(service, struct_pack(p := {PLACE_SQL}, j := job_id)) as service, arg_min(job_id, struct_pack(p := {PLACE_SQL}, j := job_id)) as job_id from jobs group by source_id""")
def job_first_hit(spark, sf_dir):
    one = stores.dedupe_keep_first(jobs(spark, sf_dir), ["source_id", "service"], ["job_id"])
    return stores.first_hit(one, key="source_id").select("source_id", "service", "job_id")


@query("job_union_namespaces", f"""with {JOBS_SQL}
select service, status, count(*) as n_jobs from jobs group by service, status""")
def job_union_namespaces(spark, sf_dir):
    j = jobs(spark, sf_dir)
    parts = [j.where(F.col("service") == s).drop("cache_key") if s == "scenes" else j.where(F.col("service") == s) for s in stores.LOOKUP_ORDER]
    return stores.union_namespaces(parts).groupBy("service", "status").agg(F.count("*").alias("n_jobs"))


@query("job_decode_json", """
select event_id as job_id, cast(regexp_extract(props, '"k": ?([0-9]+)', 1) as bigint) as k from events where event_id % 11 <> 0""")
def job_decode_json(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 11 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props")).alias("raw"))
    return stores.decode_json(raw, "raw", "k long").select("job_id", "doc.k")


@query("job_rollup_progress", """
select user_id as job_id, round(sum(value) / 4, 4) as progress from events group by user_id""")
def job_rollup_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("value").alias("progress"))
    return ops.rollup_progress(e, 4).select("job_id", F.round("progress", 4).alias("progress"))


@query("cache_valid_semi", """
select 'valid' as state, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING')
union all select 'stale', count(*) from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')""")
def cache_valid_semi(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cache_key"), F.col("o_custkey").alias("job_id"))
    live = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    good, stale = stores.valid_cache(cache, live, ["job_id"])
    return good.agg(F.count("*").alias("n")).select(F.lit("valid").alias("state"), "n").unionByName(stale.agg(F.count("*").alias("n")).select(F.lit("stale").alias("state"), "n"))


@query("cache_fresh", """
select o_orderstatus, count(*) as n from orders where o_orderdate + interval 90 day > (select max(o_orderdate) from orders) group by o_orderstatus""")
def cache_fresh(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("expires_at", F.col("o_orderdate") + F.expr("interval 90 days"))
    now = o.agg(F.max("o_orderdate").alias("now"))
    return stores.fresh(o.crossJoin(F.broadcast(now)), F.col("now")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("alias_resolve", """
select o.o_orderkey as job_id, coalesce(a.o_custkey, o.o_orderkey) as resolved from orders o left join (select o_orderkey, o_custkey from orders where o_orderkey % 4 = 0) a on a.o_orderkey = o.o_orderkey""")
def alias_resolve(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    aliases = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("alias_job_id"), F.col("o_custkey").alias("target_job_id"))
    return stores.resolve_alias(o.select(F.col("o_orderkey").alias("job_id")), aliases)


@query("clear_jobs_anti", """
select o_orderstatus, count(*) as n_left from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) group by o_orderstatus""")
def clear_jobs_anti(spark, sf_dir):
    doomed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return stores.delete_jobs(table(spark, sf_dir, "orders"), doomed, ["o_custkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n_left"))


@query("lease_request_join", """
select o_orderkey as lease_id, count(*) as n_requests from orders join events on event_id = o_orderkey group by o_orderkey""")
def lease_request_join(spark, sf_dir):
    leases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.col("o_orderkey").alias("job_id"))
    return leases.join(jobs(spark, sf_dir).select("job_id"), "job_id").groupBy("lease_id").agg(F.count("*").alias("n_requests"))


@query("merge_sources_later_wins", """
select k as name, arg_max(v, s) as definition from (
  select c_mktsegment as k, max(c_name) as v, 0 as s from customer group by 1 union all select p_brand, max(p_name), 1 from part group by 1 union all select c_mktsegment, min(c_name), 2 from customer where c_acctbal > 0 group by 1) group by k""")
def merge_sources_later_wins(spark, sf_dir):
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    tables = [c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.max("c_name").alias("definition")), p.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_name").alias("definition")), c.where("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("name")).agg(F.min("c_name").alias("definition"))]
    return stores.merge_sources(tables, "name", "definition")


@query("dedupe_canonical_json", """
select props, min(event_id) as event_id from events group by props""")
def dedupe_canonical_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return stores.dedupe_keep_first(e, ["props"], ["event_id"]).select("props", "event_id")


@query("tag_set_equality", """
select (select count(*) from ((select distinct user_id from events where event_type = 'click') except (select distinct user_id from events where event_type = 'view'))) = 0
  and (select count(*) from ((select distinct user_id from events where event_type = 'view') except (select distinct user_id from events where event_type = 'click'))) = 0 as same""")
def tag_set_equality(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = (e.where(F.col("event_type") == t).select("user_id") for t in ("click", "view"))
    return stores.set_difference(a, b).select("same")


@query("name_to_id_last_wins", """
select p_name as tag_name, max(p_partkey) as tag_id from part group by p_name""")
def name_to_id_last_wins(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("tag_name")).agg(F.max_by("p_partkey", "p_partkey").alias("tag_id"))


@query("active_jobs_by_module", f"""with {JOBS_SQL}
select service, count(*) as n_active from jobs group by service""")
def active_jobs_by_module(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("service").agg(F.count("*").alias("n_active"))


@query("queue_stats", f"""
select user_id as worker, count(*) filter (where event_id % 4 = 1) as n_pending, count(*) filter (where event_id % 4 = 2) as n_active, arg_max(event_id, event_id) filter (where event_id % 4 = 2) as active_job from events group by user_id""")
def queue_stats(spark, sf_dir):
    state = F.when(F.col("event_id") % 4 == 1, "queued").when(F.col("event_id") % 4 == 2, "processing").otherwise("completed")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("job_id"), F.col("event_id").alias("started"), state.alias("status"))
    return resources.queue_stats(e, "worker")


@query("rolling_metrics", """
select user_id, event_id, avg(cast(round(value * 100) as bigint)) over (partition by user_id order by event_id rows between 719 preceding and current row) as avg_cents from events""")
def rolling_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return resources.rolling(e, ["user_id"], ["event_id"], ["cents"], decimals=None)


@query("latest_averages", """
select user_id, arg_max(total, event_id) as total_mb, count(*) as n_samples from (
  select user_id, event_id, event_id % 100 as total, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 30 group by user_id""")
def latest_averages(spark, sf_dir):
    m = table(spark, sf_dir, "events").withColumn("total_mb", F.col("event_id") % 100)
    return resources.latest_averages(m, ["user_id"], ["event_id"], ["value"], ["total_mb"], samples=30).select("user_id", "total_mb", "n_samples")


LEASES_SQL = "leases as (select event_id as lease_id, event_type as device, cast(floor(value) as double) as vram_mb from events)"


def leases(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("lease_id"), F.col("event_type").alias("device"), F.floor("value").cast("double").alias("vram_mb"))


@query("lease_available", f"""with {LEASES_SQL}
select device, sum(vram_mb) as leased_mb, sum(vram_mb) + 75 as allocated_mb, greatest(0, 3e9 - sum(vram_mb)) as available_mb from leases group by device""")
def lease_available(spark, sf_dir):
    return resources.available(leases(spark, sf_dir), "device", 3e9, 75.0)


@query("vram_segments", f"""with {LEASES_SQL}, used as (select device, sum(vram_mb) as u from leases group by device)
select device, segment, mb, round(mb * 100 / 6e7, 6) as percent from (
  select device, cast(lease_id as varchar) as segment, vram_mb as mb from leases union all select device, 'unaccounted', 75.0 from used union all select device, 'free', greatest(0, 6e7 - u - 75) from used)""")
def vram_segments(spark, sf_dir):
    return resources.segments(leases(spark, sf_dir), "device", 6e7, 75.0).withColumn("percent", F.round("percent", 6))


REQUESTS_SQL = "requests as (select event_id as request_id, event_type as device, event_id % 5 as priority, epoch_us(ts) as asked, cast(floor(value) as double) as vram_mb from events)"


def requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("device"), (F.col("event_id") % 5).alias("priority"), F.unix_micros("ts").alias("at"), F.floor("value").cast("double").alias("vram_mb"))


@query("queue_grant", f"""with {REQUESTS_SQL}, ranked as (
  select *, row_number() over w as position, sum(vram_mb) over (partition by device order by priority, asked, request_id rows unbounded preceding) as so_far from requests window w as (partition by device order by priority, asked, request_id))
select request_id, device, position, position * 60 as wait_s, so_far <= 3000 as granted from ranked""")
def queue_grant(spark, sf_dir):
    placed = resources.queue(requests(spark, sf_dir), "device", ["priority", "at", "request_id"], F.lit(3000.0))
    return placed.select("request_id", "device", F.col("position").cast("long").alias("position"), F.col("wait_s").cast("long").alias("wait_s"), "granted")


@query("lease_expiry", """
select event_id as lease_id, (now > started + 600) or ((now - beat > 60) and event_id % 3 <> 0) as expired, beat + 600 as renewed_until from (
  select event_id, epoch_us(ts) / 1000000 as started, epoch_us(ts) / 1000000 + event_id % 200 as beat, epoch_us(ts) / 1000000 + event_id % 900 as now from events)""")
def lease_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", seconds().alias("s"))
    beat, now = F.col("s") + F.col("event_id") % 200, F.col("s") + F.col("event_id") % 900
    return e.select(F.col("event_id").alias("lease_id"), resources.expired(now, F.col("s") + resources.LEASE_S, beat, F.col("event_id") % 3 == 0).alias("expired"), resources.renewed(beat).alias("renewed_until"))


@query("vram_reconcile", """
select event_id, case when abs(greatest(0.0, value * 3 - 500) - event_id % 400) > 50 then greatest(0.0, value * 3 - 500) else cast(event_id % 400 as double) end as unaccounted from events""")
def vram_reconcile(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", resources.reconcile(F.col("value") * 3, F.lit(500.0), (F.col("event_id") % 400).cast("double")).alias("unaccounted"))


@query("lease_transitions", """
select state, event, n, case when (state, event) in (('active','start'),('idle','start')) then 'busy' when state = 'busy' and event = 'finish' then 'idle'
  when state in ('active','idle') and event = 'evict' then 'releasing' when state in ('active','idle') and event = 'expire' then 'expired' else state end as next_state
from (select case event_id % 3 when 0 then 'active' when 1 then 'idle' else 'busy' end as state, case event_type when 'click' then 'start' when 'view' then 'finish' when 'error' then 'evict' else 'expire' end as event, count(*) as n from events group by 1, 2)""")
def lease_transitions(spark, sf_dir):
    state = F.when(F.col("event_id") % 3 == 0, "active").when(F.col("event_id") % 3 == 1, "idle").otherwise("busy")
    event = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "finish").when(F.col("event_type") == "error", "evict").otherwise("expire")
    counts = table(spark, sf_dir, "events").groupBy(state.alias("state"), event.alias("event")).agg(F.count("*").alias("n"))
    return counts.withColumn("next_state", resources.next_state(F.col("state"), F.col("event")))


@query("idle_sessions", """
select user_id, min(s) as loaded_us, max(s) + 3600000000 as unloaded_us, count(*) as n_uses from (
  select *, sum(new) over (partition by user_id order by s, event_id rows unbounded preceding) as sess from (
    select user_id, event_id, epoch_us(ts) as s, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 3600000000 then 0 else 1 end as new from events)) group by user_id, sess""")
def idle_sessions(spark, sf_dir):
    found = resources.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "3600 seconds")
    return found.select("user_id", F.unix_micros("loaded_at").alias("loaded_us"), F.unix_micros("unloaded_at").alias("unloaded_us"), "n_uses")


# A service is an event type; on each of twenty devices views wait for what the others hold.
RELEASED_SQL = """held as (select user_id % 20 as device, event_type as service, cast(floor(value) as double) as vram_mb from events where event_type <> 'view'),
free as (select device, greatest(0.0, 20000 - sum(case when service = 'click' then 0 else vram_mb end)) as mb from held group by device),
placed as (select event_id as request_id, user_id % 20 as device, row_number() over w as position, sum(cast(floor(value) as double)) over (w rows unbounded preceding) as so_far
  from events where event_type = 'view' window w as (partition by user_id % 20 order by event_id % 5, epoch_us(ts), event_id))"""


@query("release_service_leases", f"""with {RELEASED_SQL}
select request_id, p.device, position, so_far <= coalesce(mb, 20000) as granted from placed p left join free using (device)""")
def release_service_leases(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 20).alias("device"), F.col("event_type").alias("service"), (F.col("event_id") % 5).alias("priority"), F.unix_micros("ts").alias("at"), F.floor("value").cast("double").alias("vram_mb"))
    asked = resources.release_service(e.where("service <> 'view'"), e.where("service = 'view'"), "device", "click", ["priority", "at", "request_id"], 20000.0)
    return asked.select("request_id", "device", F.col("position").cast("long").alias("position"), "granted")


@query("idle_unless_busy", """
select user_id, min(s) as loaded_us, max(e) as unloaded_us, count(*) as n_uses from (
  select *, sum(new) over (partition by user_id order by s, event_id rows unbounded preceding) as sess from (
    select *, case when s < max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from (
      select user_id, event_id, epoch_us(ts) as s, epoch_us(ts) + (3600 + event_id % 7 * 600) * 1000000 as e from events))) group by user_id, sess""")
def idle_unless_busy(spark, sf_dir):
    found = resources.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "3600 seconds", busy=F.col("event_id") % 7 * 600)
    return found.select("user_id", F.unix_micros("loaded_at").alias("loaded_us"), F.unix_micros("unloaded_at").alias("unloaded_us"), "n_uses")
