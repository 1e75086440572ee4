"""Streams over the events table, run to its end; each must equal what a batch says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import jobs as streams
from .base import query, table


def event_stream(spark, sf_dir):
    like = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = streams.file_stream(spark, f"{sf_dir}/events.parquet", like)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


QUEUE_SQL = """
select 'q' || user_id % 16 as queue, count(*) filter (where event_type not in ('click', 'error', 'signup')) as n_submit, count(*) filter (where event_type = 'click') as n_acquire, count(*) filter (where event_type = 'signup') as n_release,
  count(*) filter (where event_type = 'error') as n_recover, max(event_id) filter (where event_type not in ('click', 'error', 'signup')) as last_submit, max(event_id) filter (where event_type = 'click') as last_acquire from events group by 1"""
LEASE_SQL = """
select *, beat + 600 as expires from (select 'gpu' || user_id % 16 as device, user_id % 50 as lease_id, cast(floor(arg_max(value, event_id) filter (where event_type = 'view')) as double) as mb,
  cast(max(event_id * 5) filter (where event_type not in ('error', 'signup')) as double) as beat,
  coalesce(max(event_id) filter (where event_type = 'error') > max(event_id) filter (where event_type not in ('error', 'signup')), false) as released, count(*) as n_events from events group by 1, 2)"""


def queue_events(e):
    kind = F.when(F.col("event_type") == "click", "acquire").when(F.col("event_type") == "error", "recover").when(F.col("event_type") == "signup", "release").otherwise("submit")
    return e.select(F.concat(F.lit("q"), (F.col("user_id") % 16).cast("string")).alias("queue"), F.col("event_id").alias("seq"), kind.alias("kind"))


def lease_events(e):
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "error", "release_all").when(F.col("event_type") == "signup", "measure").otherwise("busy")
    return e.select(F.concat(F.lit("gpu"), (F.col("user_id") % 16).cast("string")).alias("device"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("user_id") % 50).alias("lease_id"), F.floor("value").cast("double").alias("mb"), (F.col("event_id") * 5).cast("double").alias("at"))


@query("stream_job_queue", QUEUE_SQL)
def stream_job_queue(spark, sf_dir):
    return streams.run_once(streams.queue_progress(queue_events(event_stream(spark, sf_dir))), shared_folder(spark, "stream-queue"), "complete")


@query("replay_job_queue", QUEUE_SQL)
def replay_job_queue(spark, sf_dir):
    return streams.queue_progress(queue_events(table(spark, sf_dir, "events")))


@query("stream_leases", LEASE_SQL)
def stream_leases(spark, sf_dir):
    return streams.run_once(streams.lease_states(lease_events(event_stream(spark, sf_dir))), shared_folder(spark, "stream-leases"), "complete")


@query("replay_leases", LEASE_SQL)
def replay_leases(spark, sf_dir):
    return streams.lease_states(lease_events(table(spark, sf_dir, "events")))


@query("stream_job_lifecycle", """
select user_id as job_id, arg_max(event_type, event_id) as status, arg_max(value, event_id) as progress, max(event_id) as seq from events group by user_id""")
def stream_job_lifecycle(spark, sf_dir):
    updates = event_stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("value").alias("progress"))
    return streams.run_once(streams.lifecycle(updates), shared_folder(spark, "stream-lifecycle"), "complete")


@query("stream_windowed_metrics", """
select epoch_us(date_trunc('hour', ts)) as start_us, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from events group by 1""")
def stream_windowed_metrics(spark, sf_dir):
    e = event_stream(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    done = streams.run_once(streams.windowed_metrics(e, "ts", "cents"), shared_folder(spark, "stream-metrics"), "complete")
    return done.select(F.unix_micros("start").alias("start_us"), "n", "total")


@query("stream_rollup_progress", """
select event_type as parent_id, cast(sum(user_id) as bigint) as units from events join customer on c_custkey = event_id % 100 + 1 group by event_type""")
def stream_rollup_progress(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    updates = event_stream(spark, sf_dir).select((F.col("event_id") % 100 + 1).alias("job_id"), F.col("user_id").cast("double").alias("progress"), F.col("event_type").alias("parent_id"))
    done = streams.run_once(streams.progress_stream(updates, jobs, 1), shared_folder(spark, "stream-progress"), "complete")
    return done.select("parent_id", F.col("progress").cast("long").alias("units"))


@query("stream_idle_unload", """
select * from (select user_id, min(s) as loaded_us, max(s) + 3600000000 as unloaded_us, count(*) as n_uses from (
  select *, sum(new) over (partition by user_id order by s, event_id rows unbounded preceding) as sess from (
    select user_id, event_id, epoch_us(ts) as s, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 3600000000 then 0 else 1 end as new from events)) group by user_id, sess)
where unloaded_us <= (select max(epoch_us(ts)) // 1000 * 1000 - 7200000000 from events)""")
def stream_idle_unload(spark, sf_dir):
    """Models unloaded for want of use, up to two hours before the newest event."""
    done = streams.run_once(streams.idle_unloads(event_stream(spark, sf_dir), "user_id", "ts", "3600 seconds", "2 hours"), shared_folder(spark, "stream-idle"))
    return done.select("user_id", F.unix_micros("loaded_at").alias("loaded_us"), F.unix_micros("unloaded_at").alias("unloaded_us"), "n_uses")
