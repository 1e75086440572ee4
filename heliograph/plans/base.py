"""The register of queries, and the engine's record types derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times without a zone are read in the session's, which should be UTC."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


# Jobs: each event is one, its type is the service; some have no, an unreadable or a numeric creation time.
JOBS_SQL = """
jobs as (
  select event_id as job_id,
    case event_type when 'view' then 'vision' when 'click' then 'faces' when 'error' then 'scenes' when 'purchase' then 'semantics' else 'objects' end as service,
    case when event_type = 'error' then 'failed' when event_id % 3 = 0 then 'processing' else 'completed' end as status,
    'user-' || user_id as source_id, value as progress,
    case when event_id % 97 = 0 then null when event_id % 89 = 0 then 0.0 else floor(epoch(ts)) end as created_s
  from events)
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    service = F.when(F.col("event_type") == "view", "vision").when(F.col("event_type") == "click", "faces").when(F.col("event_type") == "error", "scenes").when(F.col("event_type") == "purchase", "semantics").otherwise("objects")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 3 == 0, "processing").otherwise("completed")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    created = F.when(F.col("event_id") % 97 == 0, F.lit(None)).when(F.col("event_id") % 89 == 0, "not a date").when(F.col("event_id") % 83 == 0, F.floor(F.unix_micros("ts") / 1_000_000).cast("string")).otherwise(iso)
    return e.select(F.col("event_id").alias("job_id"), service.alias("service"), status.alias("status"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"), F.lit("events").alias("source"), F.col("value").alias("progress"), created.alias("created_at"), F.col("user_id").alias("worker"), F.lit(None).cast("string").alias("cache_key"), F.lit(None).cast("string").alias("completed_at"))


def seconds(column: str = "ts"):
    return (F.unix_micros(column) / 1_000_000).cast("double")
