"""Training-order materialisation of token sequences.

1. Each text becomes ids (and the end id), cut in sequences of at most ``length`` ids.  They are
   written once to the shared folder, numbered densely there: the number of a written partition's
   first sequence plus the place in it.  Numbers thus stay what they are whatever is lost later.
2. A keyed Feistel permutation of [0, 4^k), walked along its cycle until it is below N, gives
   every number its slot in the training order: a bijection of [0, N) that needs no sort or state.
3. Slots are dealt out by range to shards of ``per_shard`` slots.  A shard is one binary value of
   fixed stride: slot s is at byte (s mod per_shard) * stride of shard s div per_shard, as a 32-bit
   count and ``length`` 16-bit ids, padded with 0.  A reader can start at any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts, written
from .token_ids import encoder, pack_vocabulary

ROUNDS = 6


def stride(length: int) -> int:
    return 4 + 2 * length


def sequences(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, seq_no, n_ids, ids (16 bits each, compressed with zstd for the way to their shard) of every row's sequences.

    A null or empty text gives one sequence, the end id alone; repeated rows have sequences of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pack_vocabulary(vocabulary))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        enc, end = encoder(shared.value), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                ids = enc.ids(text) + end
                for n, at in enumerate(range(0, len(ids), 2 * length)):
                    one = ids[at : at + 2 * length]
                    out.append((None if doc_id is None or doc_id != doc_id else int(doc_id), n, len(one) // 2, squeeze(one)))
                    held += len(one)
                if held > 4 << 20:
                    yield _frame(out)
                    out, held = [], 0
            yield _frame(out)

    return texts(docs).mapInPandas(cut, "doc_id long, seq_no long, n_ids long, ids binary")


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "seq_no", "n_ids", "ids"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def numbered(seqs: DataFrame) -> tuple[DataFrame, int]:
    """The sequences, written, with a dense ``number``, and how many there are."""
    kept = written(seqs.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sequences")
    counts = kept.groupBy("part").agg(F.count("*").alias("n"))  # a row for each written partition: some bytes a file
    first = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    total = counts.agg(F.sum("n")).head()[0] or 0
    return kept.join(F.broadcast(first), "part").withColumn("number", F.col("first") + F.col("pos")).drop("first", "part", "pos"), total


def feistel_slot(number: Column, total: int, key: str) -> Column:
    """The slot of each number: a keyed permutation of [0, total)."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    keys = [zlib.crc32(f"{key}:{r}".encode()) | (zlib.crc32(f"{r}:{key}".encode()) << 32) for r in range(ROUNDS)]

    @F.pandas_udf("long")
    def walked(batch: pd.Series) -> pd.Series:
        return pd.Series(permute(batch.to_numpy(dtype=np.uint64), total, half, keys).astype(np.int64))

    return walked(number)


def permute(numbers: np.ndarray, total: int, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            z = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        x = once(numbers)
        while (far := x >= np.uint64(total)).any():  # the walk ends: a cycle comes back below total
            x[far] = once(x[far])
    return x


def shards(slotted: DataFrame, total: int, length: int = 2048, per_shard: int = 512) -> DataFrame:
    """shard, first_slot, n_slots, payload (binary of fixed stride), in slot order."""
    size = stride(length)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor().decompress
        shard = int(key[0])
        first = shard * per_shard
        n = min(per_shard, total - first)
        payload = bytearray(n * size)
        for slot, n_ids, ids in zip(rows["slot"], rows["n_ids"], rows["ids"], strict=True):
            at = (int(slot) - first) * size
            payload[at : at + 4] = int(n_ids).to_bytes(4, "little")
            payload[at + 4 : at + 4 + 2 * int(n_ids)] = unsqueeze(ids)
        return pd.DataFrame({"shard": [shard], "first_slot": [first], "n_slots": [n], "payload": [bytes(payload)]})

    ranged = slotted.select("slot", "n_ids", "ids", F.floor(F.col("slot") / per_shard).cast("long").alias("shard")).repartitionByRange("shard")
    return ranged.groupBy("shard").applyInPandas(fill, "shard long, first_slot long, n_slots long, payload binary")


def read_slots(shard_rows: DataFrame, length: int = 2048) -> DataFrame:
    """slot, n_ids and crc32 of the ids (unsigned 16-bit) as they are in the shards."""
    size = stride(length)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, first, n, payload in zip(batch["shard"], batch["first_slot"], batch["n_slots"], batch["payload"], strict=True):
                out = []
                for i in range(n):
                    n_ids = int.from_bytes(payload[i * size : i * size + 4], "little")
                    out.append((shard, first + i, i * size, n_ids, zlib.crc32(payload[i * size + 4 : i * size + 4 + 2 * n_ids])))
                yield pd.DataFrame(out, columns=["shard", "slot", "byte_offset", "n_ids", "ids_crc32"])

    return shard_rows.mapInPandas(read, "shard long, slot long, byte_offset long, n_ids long, ids_crc32 long")


def read_range(shard_rows: DataFrame, first: int, end: int, length: int = 2048) -> DataFrame:
    """Slots first to end - 1, in order within a shard: what a reader that stopped at first goes on with. Other shards aren't read."""
    near = shard_rows.where((F.col("first_slot") < end) & (F.col("first_slot") + F.col("n_slots") > first))
    return read_slots(near, length).where(F.col("slot").between(first, end - 1))


def materialise(docs: DataFrame, vocabulary: str, key: str = "epoch-0", length: int = 2048, per_shard: int = 512, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The ledger (doc_id, seq_no, slot of each sequence) and the written shards.

    ``path``: where shards stay (none: in the shared folder), as Parquet rows of one binary value each.  A null text is empty and gives
    the end id alone; null ids and repeated rows have sequences of their own.  No rows give no sequences and no shards.
    """
    rows, total = numbered(sequences(docs, vocabulary, length))
    slotted = rows.withColumn("slot", feistel_slot(F.col("number"), total, key))
    made = shards(slotted, total, length, per_shard)
    if path is None:
        return slotted.select("doc_id", "seq_no", "slot"), written(made, "shards", "zstd")
    made.write.parquet(path, compression="zstd")
    return slotted.select("doc_id", "seq_no", "slot"), docs.sparkSession.read.schema(made.schema).parquet(path)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ledger, out = materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return ledger.join(read_slots(out), "slot").select("doc_id", "seq_no", "slot", "shard", "byte_offset", "n_ids", "ids_crc32")
