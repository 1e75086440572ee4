"""Job stores: scans of namespaces, lookups, upserts, expiry and deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The namespaces that listings cover, in their order of lookup.
NAMESPACES = ("vision", "faces", "scenes", "semantics", "objects", "captions")
LOOKUP_ORDER = ("vision", "faces", "scenes", "semantics", "objects")


def scan(spark: SparkSession, path: str, services: tuple[str, ...] | None = None) -> DataFrame:
    """The jobs table, partitioned by service on disk; naming services prunes the others' files."""
    jobs = spark.read.parquet(path)
    return jobs.where(F.col("service").isin(*services)) if services else jobs


def union_namespaces(tables: list[DataFrame]) -> DataFrame:
    """All namespaces' rows; columns that a namespace lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def decode_json(rows: DataFrame, column: str, schema: str, into: str = "doc") -> DataFrame:
    """Rows whose JSON can be read, with it as a struct; unreadable ones are skipped."""
    parsed = rows.withColumn(into, F.from_json(column, f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    return parsed.where(F.col(into).isNotNull() & F.col(into)["__corrupt"].isNull())


def lookup(jobs: DataFrame, job_id: str, service: str) -> DataFrame:
    return jobs.where((F.col("service") == service) & (F.col("job_id") == job_id))


def lookup_each(asked: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``asked`` with ``found`` and ``row``, a struct of the other columns of the row of that key.

    A null in a key finds nothing; of several rows of a key the smallest counts, so no request is repeated.
    """
    rest = F.struct(*(c for c in rows.columns if c not in key))
    one = rows.groupBy(*key).agg(F.min(rest).alias("row"))
    return asked.join(one, key, "left").withColumn("found", F.col("row").isNotNull())


def first_hit(jobs: DataFrame, order: tuple[str, ...] = LOOKUP_ORDER, key: str = "job_id") -> DataFrame:
    """For each job id the row of the first namespace (in lookup order) that has it."""
    place = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("service"))
    known = jobs.withColumn("__place", place).where("__place > 0")
    rest = [c for c in jobs.columns if c != key]
    return known.groupBy(key).agg(F.min_by(F.struct(*rest), "__place").alias("__row")).select(key, "__row.*")


def keep_unless_given(new: Column, old: Column) -> Column:
    """Upsert of a text: a null or empty new value keeps the old one."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def fold_updates(updates: DataFrame, key: str, order: list[str], sticky: list[str], last: list[str]) -> DataFrame:
    """Latest state by key of an update log: ``sticky`` columns keep their last non-empty value, ``last`` ones their last value."""
    place = F.struct(*order)
    filled = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), place)
    return updates.groupBy(key).agg(*(F.max_by(c, filled(c)).alias(c) for c in sticky), *(F.max_by(c, place).alias(c) for c in last))


def fresh(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return rows.where(F.col(expires) > now)


def valid_cache(cache: DataFrame, jobs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cache entries whose job still exists, and stale ones."""
    return cache.join(jobs.select(*key).distinct(), key, "left_semi"), cache.join(jobs.select(*key).distinct(), key, "left_anti")


def resolve_alias(ids: DataFrame, aliases: DataFrame, key: str = "job_id") -> DataFrame:
    """ids with ``resolved``: the alias's target, one hop only."""
    hop = aliases.select(F.col("alias_job_id").alias(key), "target_job_id")
    return ids.join(hop, key, "left").withColumn("resolved", F.coalesce("target_job_id", key)).drop("target_job_id")


def delete_jobs(rows: DataFrame, doomed: DataFrame, key: list[str]) -> DataFrame:
    """What is left after jobs (or cache entries by their value) are cleared."""
    return rows.join(doomed.select(*key).distinct(), key, "left_anti")


def dedupe_keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row (by order) of each key, with all columns."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def merge_sources(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of maps: of equal keys the later table's value stays."""
    marked = [t.select(F.col(key), F.col(value), F.lit(i).alias("__source")) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, marked).groupBy(key).agg(F.max_by(value, "__source").alias(value))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_only_a and n_only_b of two single-column tables, and whether they hold the same set."""
    told = a.select(F.col(a.columns[0]).alias("x"), F.lit(1).alias("side")).unionByName(b.select(F.col(b.columns[0]).alias("x"), F.lit(2).alias("side")))
    seen = told.groupBy("x").agg(F.bit_or("side").alias("sides"))
    counts = seen.agg(F.count_if(F.col("sides") == 1).alias("n_only_a"), F.count_if(F.col("sides") == 2).alias("n_only_b"))
    return counts.withColumn("same", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two single-column tables hold the same set; decides a taxonomy's reload."""
    return set_difference(a, b).head().same
