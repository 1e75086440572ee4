"""What the operators of this subpackage share: input columns, the shared folder, joins with hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of texts that go to a Python worker at a time; long texts would make the usual batches large.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS and BATCH_BYTES unless they are smaller already.

    The settings stay: Spark reads them when a result is computed, which is after an operator has returned.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def trimmed(batches: Iterator) -> Iterator:
    """The batches; when they end, the worker gives freed memory back, since it lives on beside the executor's heap for the stages that follow."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only (a null text is empty): other columns can't clash with an operator's own."""
    small_batches(docs.sparkSession)
    shared_dir(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is made only for a local master that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    set_before = sc._jsc.sc().getCheckpointDir()
    if not named and set_before.isDefined():
        return set_before.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = named or tempfile.mkdtemp(prefix="spark-heliograph-")
    if not set_before.isDefined():
        sc.setCheckpointDir(named)
    return named


_tables: list[str] = []


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, read again: later steps start there, also after a lost executor."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """A mark for ``drop_tables``: how many tables this process has written and not dropped."""
    return len(_tables)


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written since a mark, all but the last ``keep``; results that still read them must be saved first."""
    sc = spark.sparkContext
    end = len(_tables) - keep
    for path in _tables[since:end]:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    del _tables[since:end]


#: Keys that are broadcast as hot, at most, and the rows of a key from which it may be one.
HOT_KEYS, HOT_ROWS = 50_000, 20_000


def join_counted(rows: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with counts (a row a key; n: its number of rows) where keys may hold a third of all rows.

    Keys of more than HOT_ROWS rows and of more than one in HOT_KEYS of all rows are fewer than HOT_KEYS; they are
    broadcast, so their rows stay where they are.  The others meet in a shuffle.
    """
    total = counts.agg(F.sum("n")).head()[0] or 0
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = counts.where(F.col("n") > bound)
    if hot.isEmpty():
        return rows.join(counts.drop("n"), on)
    few = F.broadcast(hot.drop("n"))
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(counts.where(F.col("n") <= bound).drop("n"), on)
    return rows.join(few, on).unionByName(others)


def crc_fold(column: Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % modulus
