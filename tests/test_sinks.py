from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from heliograph.sources import sinks
from heliograph.streaming import jobs as streams


def test_results_expire_and_upsert(spark):
    path = tempfile.mkdtemp(prefix="spark-sinks-")
    rows = spark.createDataFrame([(1, "faces", "k1"), (2, "scenes", "k2")], "job_id long, service string, cache_key string")
    sinks.write_results(rows, f"{path}/results", 3600)
    sinks.write_results(rows.where("job_id = 1"), f"{path}/results", -10)
    stored = spark.read.parquet(f"{path}/results")
    assert stored.count() == 3
    sinks.expire(stored, f"{path}/fresh")
    assert spark.read.parquet(f"{path}/fresh").count() == 2
    old = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, status string")
    sinks.write_upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], old.schema), ["job_id"], f"{path}/jobs")
    assert sorted(map(tuple, spark.read.parquet(f"{path}/jobs").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_publish_sends_the_latest_of_each_job(spark):
    path, sent = tempfile.mkdtemp(prefix="spark-publish-"), []
    spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 1, "queued")], "job_id long, seq long, status string").write.parquet(f"{path}/updates")
    stream = streams.file_stream(spark, f"{path}/updates", spark.read.parquet(f"{path}/updates"))
    sinks.publish(stream, lambda batch, n: sent.extend(map(tuple, batch.collect())), f"{path}/log").awaitTermination()
    assert sorted(sent) == [(1, 2, "done"), (2, 1, "queued")]


def test_metrics_source(spark):
    source = type("Samples", (sinks.Metrics,), {"sample": staticmethod(lambda: (1.0, 50.0, 1.0, 2.0, 3.0, 4.0, 5.0))})
    spark.dataSource.register(source)
    path = tempfile.mkdtemp(prefix="spark-metrics-")
    query = spark.readStream.format("metrics").load().writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").start()
    query.awaitTermination(15)
    query.stop()
    got = spark.read.parquet(f"{path}/out")
    assert got.count() >= 1 and got.agg(F.max("gpu_pct")).head()[0] == 50.0


def test_windowed_metrics_leave_late_rows_out(spark):
    path = tempfile.mkdtemp(prefix="spark-late-")
    import time

    for n, hours in enumerate(([0, 1, 9], [10], [11], [0])):
        time.sleep(0.05)
        spark.createDataFrame([(f"2024-01-01 {h:02d}:30:00", 1) for h in hours], "t string, v long").select(F.to_timestamp("t").alias("t"), "v").coalesce(1).write.parquet(f"{path}/in/{n}")
    like = spark.read.parquet(f"{path}/in/0")
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    done = streams.run_once(streams.windowed_metrics(stream, "t", "v"), f"{path}/run", "append")
    assert all(r.n == 1 for r in done.collect())
