"""Job queue, lease and lifecycle streams: aggregates by key that hold over a stream and over a table alike."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.resources import LEASE_S, idle_sessions


def queue_progress(events: DataFrame) -> DataFrame:
    """Of each queue how many events of each kind (submit, acquire, release, recover) there were, and the last submitted and acquired one."""
    of = lambda kind: F.col("kind") == kind
    counts = [F.count_if(of(k)).alias(f"n_{k}") for k in ("submit", "acquire", "release", "recover")]
    return events.groupBy("queue").agg(*counts, F.max(F.when(of("submit"), F.col("seq"))).alias("last_submit"), F.max(F.when(of("acquire"), F.col("seq"))).alias("last_acquire"))


def lease_states(events: DataFrame) -> DataFrame:
    """Of each lease of a device the memory last asked for, its last sign of life, when it runs out, and whether its service's release came after that."""
    of = lambda *kinds: F.col("kind").isin(*kinds)
    beat, freed = F.max(F.when(of("request", "heartbeat", "busy"), F.col("at"))), F.max(F.when(of("release_all"), F.col("at")))
    held = events.groupBy("device", "lease_id").agg(F.max_by("mb", F.when(of("request"), F.col("seq"))).alias("mb"), beat.alias("beat"), freed.alias("freed"), F.count("*").alias("n_events"))
    return held.select("device", "lease_id", "mb", "beat", (F.col("beat") + LEASE_S).alias("expires"), F.coalesce(F.col("freed") > F.col("beat"), F.lit(False)).alias("released"), "n_events")


def lifecycle(updates: DataFrame) -> DataFrame:
    """Latest status by job of an update log (job_id, seq, status, progress); also over a stream, in complete or update mode."""
    return updates.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("progress", "seq").alias("progress"), F.max("seq").alias("seq"))


def windowed_metrics(metrics: DataFrame, time: str, gauge: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Means by tumbling window; rows later than the watermark are left out once their window is closed."""
    windowed = metrics.withWatermark(time, late) if metrics.isStreaming else metrics
    return windowed.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum(gauge).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def progress_stream(updates: DataFrame, jobs: DataFrame, modules: int) -> DataFrame:
    """Rollup progress: a stream of module updates joined with the static jobs they belong to."""
    return updates.join(jobs, "job_id").groupBy("parent_id").agg((F.sum("progress") / modules).alias("progress"))


def idle_unloads(uses: DataFrame, key: str, time: str, gap: str = "300 seconds", late: str = "60 seconds") -> DataFrame:
    """Unload events of models: key, loaded_at, unloaded_at, n_uses, each given once, when the watermark has passed its end.

    For append mode.  A use that comes later than ``late`` behind the newest one may find its session closed and is left out
    then (``LateRows`` counts); over a table all sessions are given.  Sessions that are still open stay in the state.
    """
    return idle_sessions(uses.withWatermark(time, late) if uses.isStreaming else uses, key, time, gap)


class LateRows(StreamingQueryListener):
    """``n``: what a stream left out as it came behind the watermark, over all of its batches.

    Spark counts ahead of the state, where uses of one batch that fall in one session are one.
    """

    def __init__(self) -> None:
        super().__init__()
        self.n, self.ended = 0, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.n += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files (or its single file) as a stream, with the columns of the table as read.

    The last letter is given as a glob, as a stream takes a plain path for a folder.
    """
    path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def run_once(stream: DataFrame, folder: str, mode: str = "append", late: LateRows | None = None) -> DataFrame:
    """All that is there now, written to a folder batch by batch; a repeated batch replaces itself. In complete mode the last batch is the result.

    late: counts what is left out while this stream alone runs.
    """
    spark = stream.sparkSession
    if late:
        spark.streams.addListener(late)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if late:
        late.ended.wait(60)  # the last progress is told before the end is
        spark.streams.removeListener(late)
    if query.lastProgress is None:
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("last"))
        out = out.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")
    return out.drop("batch")
