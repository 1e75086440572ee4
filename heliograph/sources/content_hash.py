"""Sampled content hashes: a file's size and a few of its bytes stand for its content.

SHA-256 of the size in decimal, the first SAMPLE bytes, the last SAMPLE bytes of files over two samples, and
SAMPLE bytes from the middle on of files over four.  Executors read these ranges alone; a file is never read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sample's length, and where temporary files lie.
SAMPLE = 8192
TEMPORARY = ("/tmp/", "/var/tmp/", "/temp/")


def ranges(size: int) -> list[tuple[int, int]]:
    """(offset, length) of the bytes that are read."""
    found = [(0, min(SAMPLE, size))]
    if size > 2 * SAMPLE:
        found.append((size - SAMPLE, SAMPLE))
    if size > 4 * SAMPLE:
        found.append((size // 2, SAMPLE))
    return found


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and length of the files under a folder, by Spark's own listing, which passes empty files over; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")


def file_hashes(files: DataFrame) -> DataFrame:
    """path, length, content_hash of rows (path, length); a file that can't be read has the empty hash.

    Reads go through pyarrow's file systems (local, HDFS, S3, GCS), which open the same URIs as Spark's listing.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            yield batch.assign(content_hash=[_hash(fs, p, n) for p, n in zip(batch["path"], batch["length"], strict=True)])

    return files.select("path", "length").mapInPandas(read, "path string, length long, content_hash string")


def _hash(fs, path: str, size: int) -> str:
    digest = hashlib.sha256(str(size).encode())
    try:
        local = path.startswith(("file:", "/"))  # Spark tells paths unescaped
        store, inner = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
        with store.open_input_file(inner) as file:
            for offset, length in ranges(size):
                digest.update(file.read_at(length, offset))
    except OSError:
        return ""
    return digest.hexdigest()


def content_hash(content: Column) -> Column:
    """The same hash of bytes in a column; null bytes have none."""
    size = F.octet_length(content)
    part = lambda first, length: F.substring(content, first, length)
    none = F.lit(b"")
    pieces = [F.encode(size.cast("string"), "UTF-8"), part(1, SAMPLE), F.when(size > 2 * SAMPLE, part(size - SAMPLE + 1, SAMPLE)).otherwise(none), F.when(size > 4 * SAMPLE, part(F.floor(size / 2).cast("int") + 1, SAMPLE)).otherwise(none)]
    return F.sha2(F.concat(*pieces), 256)


def is_temporary(path: Column) -> Column:
    hits = [path.startswith(p) for p in TEMPORARY]
    return hits[0] | hits[1] | hits[2]


def content_cache_key(path: Column, mtime: Column, module: str, params: Column, hashed: Column) -> Column:
    """A cache key by content for files in temporary folders that could be hashed, else by path and modification time."""
    by_content = F.sha2(F.concat_ws(":", F.lit("content"), hashed, F.lit(module), params), 256)
    by_path = F.sha2(F.concat_ws(":", path, mtime.cast("string"), F.lit(module), params), 256)
    return F.when(is_temporary(path) & (F.coalesce(hashed, F.lit("")) != ""), by_content).otherwise(by_path)
