"""Sinks: results with their expiry, job upserts, live updates, metric samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .stores import dedupe_keep_first, fresh


def write_results(results: DataFrame, path: str, ttl_seconds: int) -> None:
    """Append results and their cache keys, by service, with the time at which they expire."""
    results.withColumn("expires_at", F.current_timestamp() + F.make_interval(secs=F.lit(ttl_seconds))).write.partitionBy("service").mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old that new doesn't replace."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def write_upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """The upserted table, written as a new version beside the old one, which it reads."""
    upserted(old, new, keys).write.mode("errorifexists").parquet(path)


def expire(rows: DataFrame, path: str) -> None:
    """A new version without expired rows."""
    fresh(rows, F.current_timestamp()).write.mode("errorifexists").parquet(path)


def publish(updates: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of job updates to subscribers, the latest of each job a batch."""

    def latest(batch: DataFrame, number: int) -> None:
        send(dedupe_keep_first(batch, ["job_id"], [F.desc("seq")]), number)

    return updates.writeStream.foreachBatch(latest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Metrics(DataSource):
    """Streaming source of samples: ``sample()`` gives (ts, gpu, vram_used, vram_total, cpu, ram_used, ram_total)."""

    sample: Callable[[], tuple]

    @classmethod
    def name(cls) -> str:
        return "metrics"

    def schema(self) -> str:
        return "ts double, gpu_pct double, vram_used_mb double, vram_total_mb double, cpu_pct double, ram_used_mb double, ram_total_mb double"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _MetricsReader(type(self).sample)


class _MetricsReader(SimpleDataSourceStreamReader):
    """A sample a poll; a failed batch gets the samples it had."""

    def __init__(self, sample: Callable[[], tuple]):
        self.sample, self.seen = sample, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.seen[start["n"]] = self.sample()
        return iter([self.seen[start["n"]]]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.seen[n] for n in range(start["n"], end["n"]) if n in self.seen])

    def commit(self, end: dict) -> None:
        self.seen = {n: s for n, s in self.seen.items() if n >= end["n"]}
