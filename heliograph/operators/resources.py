"""GPU leases, queues and metrics in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running, trailing

# Buffer length, dead band, times in seconds, and the lease's states.
BUFFER, DEAD_BAND_MB, LEASE_S, SILENCE_S, WAIT_S = 720, 50.0, 600, 60, 60
TRANSITIONS = {("pending", "grant"): "active", ("active", "start"): "busy", ("idle", "start"): "busy", ("busy", "finish"): "idle", ("active", "evict"): "releasing", ("idle", "evict"): "releasing", ("releasing", "freed"): "released", ("releasing", "failed"): "idle", ("active", "expire"): "expired", ("idle", "expire"): "expired"}


def rolling(metrics: DataFrame, key: list[str], order: list[str], gauges: list[str], samples: int = BUFFER, decimals: int | None = 1) -> DataFrame:
    """Means of the last samples up to each row, to one decimal (or as they are); a gauge's rows are spread over many tasks."""
    told = trailing(metrics.select(*dict.fromkeys([*key, *order, *gauges])), key, order, samples, {f"avg_{g}": g for g in gauges})
    mean = lambda g: F.col(f"avg_{g}") if decimals is None else F.bround(f"avg_{g}", decimals)
    return told.select(*key, *order, *(mean(g).alias(f"avg_{g}") for g in gauges))


def latest_averages(metrics: DataFrame, key: list[str], order: list[str], gauges: list[str], totals: list[str], samples: int = BUFFER) -> DataFrame:
    """Means over the last samples; totals are the latest value, not a mean.

    Spark limits each task's rows of a key to ``samples`` ahead of the shuffle (for up to 1000 of them), so a hot gauge is small there.
    """
    recent = metrics.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order)))).where(F.col("__n") <= samples)
    return recent.groupBy(*key).agg(*(F.bround(F.avg(g), 1).alias(f"avg_{g}") for g in gauges), *(F.min_by(t, "__n").alias(t) for t in totals), F.count("*").alias("n_samples"))


def available(leases: DataFrame, device: str, total_mb: float, unaccounted_mb: float = 0.0) -> DataFrame:
    leased = F.coalesce(F.sum("vram_mb"), F.lit(0.0))
    return leases.groupBy(device).agg(leased.alias("leased_mb")).select(device, "leased_mb", (F.col("leased_mb") + unaccounted_mb).alias("allocated_mb"), F.greatest(F.lit(0.0), F.lit(total_mb) - F.col("leased_mb")).alias("available_mb"))


def segments(leases: DataFrame, device: str, total_mb: float, unaccounted_mb: float) -> DataFrame:
    """Bar segments: each lease, the unaccounted part if over the dead band, and what is free; with percent of total."""
    own = leases.select(device, F.col("lease_id").cast("string").alias("segment"), F.col("vram_mb").alias("mb"))
    used = leases.groupBy(device).agg(F.sum("vram_mb").alias("used"))
    extra = used.where(F.lit(unaccounted_mb) > DEAD_BAND_MB).select(device, F.lit("unaccounted").alias("segment"), F.lit(unaccounted_mb).alias("mb"))
    free = used.select(device, F.lit("free").alias("segment"), F.greatest(F.lit(0.0), F.lit(total_mb) - F.col("used") - unaccounted_mb).alias("mb"))
    return own.unionByName(extra).unionByName(free).withColumn("percent", F.col("mb") * 100.0 / total_mb)


def queue_positions(requests: DataFrame, device: str, order: list[str]) -> DataFrame:
    """1-based place by the order (priority, then time) and the expected wait; a device's queue is spread over many tasks."""
    return running(requests, [device], order, place="position").withColumn("wait_s", F.col("position") * WAIT_S)


def grants(requests: DataFrame, device: str, order: list[str], free: Column) -> DataFrame:
    """Head-of-line grants: a request is granted while everything up to it fits; the first that doesn't stops the queue."""
    return running(requests, [device], order, {"so_far_mb": "vram_mb"}).withColumn("granted", F.col("so_far_mb") <= free)


def queue(requests: DataFrame, device: str, order: list[str], free: Column) -> DataFrame:
    """Places, waits and grants of the queue in one go."""
    placed = running(requests, [device], order, {"so_far_mb": "vram_mb"}, "position")
    return placed.withColumns({"wait_s": F.col("position") * WAIT_S, "granted": F.col("so_far_mb") <= free})


def expired(now: Column, expires: Column, heartbeat: Column, busy: Column) -> Column:
    """Past its end, or silent for over a minute unless its owner says that it is busy."""
    return (now > expires) | ((now - heartbeat > SILENCE_S) & ~F.coalesce(busy, F.lit(False)))


def renewed(heartbeat: Column) -> Column:
    return heartbeat + LEASE_S


def reconcile(measured: Column, leased: Column, unaccounted: Column) -> Column:
    """The unaccounted part moves to what hardware shows only beyond the dead band."""
    seen = F.greatest(F.lit(0.0), measured - leased)
    return F.when(F.abs(seen - unaccounted) > DEAD_BAND_MB, seen).otherwise(unaccounted)


def next_state(state: Column, event: Column) -> Column:
    """The lease's state after an event; an event that doesn't apply changes nothing."""
    table = F.create_map(*(F.lit(x) for (s, e), to in TRANSITIONS.items() for x in (f"{s}:{e}", to)))
    return F.coalesce(table[F.concat_ws(":", state, event)], state)


def release_service(leases: DataFrame, requests: DataFrame, device: str, service: str, order: list[str], total_mb: float) -> DataFrame:
    """The queue after a service's leases are released: requests with position, wait and whether they are granted from what is then free."""
    held = leases.groupBy(device).agg(F.sum(F.when(F.col("service") == service, 0.0).otherwise(F.col("vram_mb"))).alias("held_mb"))
    free = F.greatest(F.lit(0.0), F.lit(total_mb) - F.coalesce("held_mb", F.lit(0.0)))
    return queue(requests.join(held, device, "left"), device, order, free)


def idle_sessions(uses: DataFrame, key: str, time: str, gap: str = "300 seconds", busy: Column | None = None) -> DataFrame:
    """Spans of use; a model unloads when no use falls within the gap. busy: seconds that a use keeps the model busy, before the gap counts."""
    after = F.expr(f"interval '{gap}'")
    held = after if busy is None else F.make_dt_interval(secs=(busy + int(gap.split()[0])).cast("decimal(18,6)"))
    whole = gap if busy is None else F.concat((busy + int(gap.split()[0])).cast("string"), F.lit(" seconds"))
    # Ends are aggregates, not the window's own: Spark moves a later filter on these ahead of the merge of sessions, which cuts them.
    spans = uses.groupBy(key, F.session_window(time, whole).alias("w")).agg(F.min(time).alias("loaded_at"), F.max(F.col(time) + held).alias("unloaded_at"), F.count("*").alias("n_uses"))
    return spans.select(key, "loaded_at", "unloaded_at", "n_uses")


def queue_stats(jobs: DataFrame, worker: str) -> DataFrame:
    return jobs.groupBy(worker).agg(F.count_if(F.col("status") == "queued").alias("n_pending"), F.count_if(F.col("status") == "processing").alias("n_active"), F.max_by("job_id", F.when(F.col("status") == "processing", F.col("started"))).alias("active_job"))
