"""Job listings: filters, page, counts, result joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_time
from ..sources.stores import NAMESPACES


def created_seconds(created: Column) -> Column:
    """Epoch seconds; text that can't be read, and no text, count 0."""
    return F.coalesce(parse_time(created), F.lit(0.0))


def in_range(created: Column, since: float | None, until: float | None) -> Column:
    """Inclusive at both ends; rows without a time pass, a bound of 0 or none is no bound."""
    at, keep = created_seconds(created), F.lit(True)
    if since:
        keep = keep & (at >= since)
    if until:
        keep = keep & (at <= until)
    return created.isNull() | (created == "") | keep


def filter_jobs(jobs: DataFrame, service: str | None = None, status: str | None = None, source: str | None = None, source_id: str | None = None, since: float | None = None, until: float | None = None) -> DataFrame:
    """Equality filters (an empty one is none; a row without the field never matches) and a creation range."""
    for column, value in (("service", service), ("status", status), ("source", source), ("source_id", source_id)):
        if value:
            jobs = jobs.where(F.col(column) == value)
    return jobs.where(in_range(F.col("created_at"), since, until)) if since or until else jobs


def page(jobs: DataFrame, limit: int = 50, offset: int = 0, dedupe_by_cache_key: bool = False) -> DataFrame:
    """Newest first; ties by namespace order, then job id. limit is held to 1..500."""
    from pyspark.sql import Window

    place = F.array_position(F.array(*(F.lit(s) for s in NAMESPACES)), F.col("service"))
    rows = jobs.withColumn("__at", created_seconds(F.col("created_at"))).withColumn("__place", place)
    if dedupe_by_cache_key:
        mine = Window.partitionBy(F.coalesce("cache_key", F.concat_ws(":", "service", "job_id"))).orderBy("__place", F.desc("__at"), "job_id")
        rows = rows.withColumn("__n", F.row_number().over(mine)).where("__n = 1").drop("__n")
    return rows.orderBy(F.desc("__at"), "__place", "job_id").offset(offset).limit(max(1, min(limit, 500))).drop("__at", "__place")


def next_offset(offset: int, limit: int, total: int) -> int | None:
    return offset + limit if offset + limit < total else None


def count_by_service(jobs: DataFrame, namespaces: tuple[str, ...] = NAMESPACES) -> DataFrame:
    """service, n_jobs: a row for each namespace, with 0 where it has none."""
    spark = jobs.sparkSession
    known = spark.createDataFrame([(s,) for s in namespaces], "service string")
    counts = jobs.groupBy("service").agg(F.count("*").alias("n"))
    return known.join(counts, "service", "left").select("service", F.coalesce("n", F.lit(0)).alias("n_jobs"))


def with_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    return jobs.join(results, ["service", "job_id"], "left")


def result_summary(module: Column, n_items: Column) -> Column:
    """Sizes of scenes and faces; other modules just say that they are done."""
    return F.when(module.isin("scenes", "faces"), n_items.cast("string")).otherwise("completed")


def result_status(status: Column) -> Column:
    """HTTP-like code of a request for results: 404 absent, 409 not completed, 200."""
    return F.when(status.isNull(), 404).when(status != "completed", 409).otherwise(200)


def summary(jobs: DataFrame) -> DataFrame:
    """The listing's projection with its defaults."""
    return jobs.select(
        "job_id", "service", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("progress", F.lit(0.0)).alias("progress"),
        F.col("source_id"), F.col("source"), F.col("created_at"), F.col("completed_at"),
    )


def operations(requested: Column) -> Column:
    """Nothing, an empty list or ``all`` stand for title, summary and tags."""
    every = F.array(F.lit("title"), F.lit("summary"), F.lit("tags"))
    return F.when(requested.isNull() | (F.size(requested) == 0) | F.array_contains(requested, "all"), every).otherwise(requested)


def modules_enabled(is_image: Column, scenes: Column, faces: Column, semantics: Column, objects: Column, by_scene: Column) -> Column:
    """Images have no scenes; tags by scene need them."""
    return F.struct((F.when(is_image, False).otherwise(scenes | (semantics & by_scene))).alias("scenes"), faces.alias("faces"), semantics.alias("semantics"), objects.alias("objects"))


def rollup_progress(progress: DataFrame, modules: int) -> DataFrame:
    """Combined progress of a job: each module weighs the same; modules not begun count 0."""
    return progress.groupBy("job_id").agg((F.sum("progress") / modules).alias("progress"))
