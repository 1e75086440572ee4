"""SimHash near-duplicates by pigeonhole blocks.

``fingerprints`` gives 64-bit SimHashes of word shingles.  ``link`` finds the components of
fingerprints that differ in at most ``radius`` bits: a fingerprint is split in radius + 2 blocks,
so a close pair agrees on at least two of them; fingerprints are joined on pairs of blocks and
each pair met is verified by its Hamming distance.  Equal fingerprints are one node from the start.

A bucket with more than BUCKET members (a large family of near copies) isn't joined with itself:
two of its members are within 2 bits of each other exactly if some value lies within one bit of both.
So each member names its neighbours at distance 0 and 1 inside the bucket's free bits, and equal
neighbours link their members in a star; work is linear in the members and no link is lost.

``near_duplicates`` is for a chosen shingle length and similarity, where close documents differ in more
bits than blocks could cover: its fingerprint has 1024 bits, the signs of a rotated count sketch of the
shingles, and its blocks are strong coordinates of further rotations.  See there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, table, texts, trimmed, written
from .components import ROWS, connected_components

SEED = 42
#: Members up to which a bucket is joined with itself.
BUCKET = 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; fewer words: one hash of them all; none: no hash."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        a, b = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    else:
        a, b = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], dtype=np.uint64)


def simhash64(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; without hashes 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([simhash64(shingle_hashes(t or "", words)) for t in batch], dtype=np.uint64).astype(np.int64))

    return hashed(text)


def block_edges(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 blocks of 64 bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links_within(prints: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    if radius not in (1, 2):
        raise ValueError("buckets beyond the limit are linked through shared neighbours, which needs a radius of 1 or 2")
    blocks = block_edges(radius)
    pairs = list(combinations(range(len(blocks)), 2))
    masks = [sum(((1 << w) - 1) << s for s, w in (blocks[i], blocks[j])) for i, j in pairs]
    keys = F.array(*(F.struct(F.lit(k).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)))
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.which", "k.key")
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1")
    small = keyed.join(sizes.where(F.col("n") <= bucket), ["which", "key"]).select("which", "key", "fp").groupBy("which", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    near = small.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.filter(F.slice("fps", F.col("i") + 2, bucket), lambda b: F.bit_count(F.col("a").bitwiseXOR(b)) <= radius)).alias("b"))
    # within one bit inside a bucket: only bits outside the agreed blocks can differ
    free = [[0, *(_signed(1 << b) for b in range(64) if not m >> b & 1)] for m in masks]
    flips = F.element_at(F.array(*(F.array(*(F.lit(x).cast("long") for x in f)) for f in free)), F.col("which") + 1)
    large = keyed.join(sizes.where(F.col("n") > bucket).select("which", "key"), ["which", "key"]).select("fp", "which", F.explode(flips).alias("flip"))
    if radius == 1:
        large = large.where("flip = 0 or fp < (fp ^ flip)")
    spread = large.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    centre = spread.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    star = spread.join(centre.select("value", "a"), "value").where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def link(marked: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id, n): for each fingerprint the smallest doc_id that links of at most ``radius`` bits reach, and its rows.

    Null ids count as the largest; they name a component only if it has no other id (then null).
    """
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).checkpoint()
    named = connected_components(links_within(nodes.select("fp"), radius, bucket))
    grouped = nodes.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "component").select("fp", "component_id", "n")


def near_components(docs: DataFrame, words: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id of every row; null texts are empty, repeated rows stay, an empty table gives no rows."""
    marked = texts(docs).select("doc_id", fingerprint(F.col("text"), words).alias("fp")).checkpoint()
    return join_counted(marked, link(marked, radius, bucket).checkpoint(), ["fp"]).select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates at a chosen similarity ----------------------------------------------------

BITS = 1024
#: Coordinates of which the strongest makes a code of a block.
GROUP = 64
ROTATIONS = 6
#: Codes (of 7 bits) in a block, at every number of documents: more would lose pairs.
CODES = 3
#: Shingles under which documents that meet are compared whatever their fingerprints.
FEW = 64
#: Members of a part of a bucket; parts are compared two by two.
PART = 512


def _turns() -> np.ndarray:
    """Fixed random rotations (Gaussian, so that coordinates of any sketch are spread alike)."""
    global _turned
    if _turned is None:
        _turned = np.random.default_rng(SEED).standard_normal((BITS, (ROTATIONS + 1) * BITS), dtype=np.float32)
    return _turned


_turned: np.ndarray | None = None


def wide_fingerprints(sketches: np.ndarray, codes_per_block: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """128-byte fingerprints and the block keys (64-bit) of count sketches."""
    turned = sketches @ _turns()
    prints = np.packbits(turned[:, :BITS] > 0, axis=1)
    grouped = turned[:, BITS:].reshape(len(sketches), -1, GROUP)
    at = np.abs(grouped).argmax(axis=2)
    codes = (2 * at + (np.take_along_axis(grouped, at[:, :, None], axis=2)[:, :, 0] > 0)).astype(np.uint64)
    tables = codes.shape[1] // codes_per_block
    codes = codes[:, : tables * codes_per_block].reshape(len(sketches), tables, codes_per_block)
    keys = np.tile(np.arange(tables, dtype=np.uint64), (len(sketches), 1))
    for c in range(codes_per_block):
        keys = keys * np.uint64(2 * GROUP) + codes[:, :, c]
    return prints, keys


def _marks(words: int, similarity: float):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in trimmed(batches):
            for at in range(0, len(batch), 128):
                part = batch.iloc[at : at + 128]
                sketches = np.zeros((len(part), BITS), dtype=np.float32)
                sizes, shapes, sets = [], [], {}
                for i, text in enumerate(part["text"]):
                    h = np.unique(shingle_hashes(text, words))
                    sketches[i] = np.bincount((h & np.uint64(BITS - 1)).astype(np.int64), weights=((h >> np.uint64(20)) & np.uint64(1)) * 2.0 - 1.0, minlength=BITS)
                    sizes.append(len(h))
                    if len(h) / (len(h) + 1) < similarity:  # only an equal set is similar
                        sets[i] = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], dtype=np.uint64)
                    seq = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
                    shapes.append(xxhash.xxh128_digest(seq))
                prints, keys = wide_fingerprints(sketches)
                keys = [sets.get(i, k).astype(np.int64) for i, k in enumerate(keys)]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "text_key": part["text_key"].to_numpy(), "shape": shapes, "fp": [p.tobytes() for p in prints], "keys": keys, "size": sizes})

    return mark


def hamming_limit(similarity: float) -> int:
    """Bits that documents of this Jaccard similarity differ in, on average, and four standard deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(BITS * share + 4 * (BITS * share * (1 - share)) ** 0.5)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and keep (boolean) of rows; one document of each group is kept.

    Documents of equal word sequences are one node.  A node's block key joins it with the smallest
    node of its bucket.  Members that this leaves outside the component of the bucket's smallest node are then
    compared with all members of other components, a part of the bucket with a part at a time, so that every two
    nodes that share a bucket end in one component if they are similar.  Pairs within the limit of Hamming
    distance of their 1024-bit fingerprints (or of few shingles) are decided by their whole shingle sets.  Blocks take
    the sign and place of the strongest of 64 rotated coordinates, which small edits seldom change, three codes to a
    block and 32 blocks at every number of documents.  Of a group the row of smallest
    doc_id stays (then smallest text_key); null ids come last.  Documents without words are one group.
    """
    rows = texts(docs).withColumn("text_key", F.xxhash64("text"))
    limit = hamming_limit(similarity)
    marked = written(rows.mapInPandas(_marks(words, similarity), "doc_id long, text_key long, shape binary, fp binary, keys array<long>, size long"), "marks")
    narrow = lambda df: df.coalesce(1 + n_rows // ROWS)  # noqa: E731  a document is some hundred bytes from here on
    n_rows = marked.count()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    shapes = marked.groupBy("shape").agg(F.min(place).alias("place"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.count("*").alias("n"))
    nodes = written(narrow(shapes.withColumn("node", F.xxhash64("shape"))), "nodes")
    blocks = nodes.select("node", F.explode("keys").alias("key"))
    heads = blocks.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    met = blocks.join(heads, "key").where("node <> head").select("node", "head").distinct()
    sides = nodes.select("node", "fp", "size")
    pairs = met.join(sides, "node").join(sides.select(F.col("node").alias("head"), F.col("fp").alias("fp2"), F.col("size").alias("size2")), "head")
    likely = pairs.where(_likely(limit, similarity)("fp", "fp2", "size", "size2")).select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = _similar(likely, nodes, rows, words, similarity)
    rest = _similar(_left_over(blocks, heads, nodes.select("node", "fp", "size", "keys"), connected_components(near, near.count()), limit, similarity), nodes, rows, words, similarity)
    names = connected_components(near.unionByName(rest), near.count() + rest.count())
    grouped = nodes.select("node", "shape", "place", "n").join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = grouped.groupBy("component").agg(F.min("place").alias("best"))
    chosen = written(narrow(grouped.join(best, "component").select("shape", "best", "n")), "chosen")
    return narrow(join_counted(marked, chosen, ["shape"])).select("doc_id", "text_key", place.eqNullSafe(F.col("best")).alias("keep"))


def _likely(limit: int, similarity: float):
    """Whether fingerprints are within the limit, or shingles few, and sizes allow the similarity."""

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint64).reshape(len(s), -1) for s in (a, b))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        least, most = np.minimum(m, n).to_numpy(), np.maximum(m, n).to_numpy()
        return pd.Series((least >= similarity * most - 1e-9) & ((apart <= limit) | (most < FEW)))

    return likely


def _left_over(blocks: DataFrame, heads: DataFrame, sides: DataFrame, names: DataFrame, limit: int, similarity: float) -> DataFrame:
    """Likely pairs (a, b) of different components within buckets; one of them is outside the component of the bucket's head.

    A pair comes from the first bucket that it shares alone, not from each.
    """
    of = lambda node, name: names.select(F.col("node").alias(node), F.col("component").alias(name))
    named = blocks.join(heads.where("n > 2"), "key").where("n > 2").join(of("node", "own"), "node", "left").join(of("head", "first"), "head", "left")
    own = F.coalesce("own", "node")
    member = written(named.select("key", "node", "n", own.alias("own"), (own != F.coalesce("first", "head")).alias("rest")), "members")
    live = member.where("rest").groupBy("key").agg(F.count("*").alias("n_rest"))
    held = member.join(live, "key").join(sides, "node")
    parts = lambda n: F.ceil(n / F.lit(PART)).cast("int")
    own_part = lambda n: F.pmod(F.xxhash64("node"), parts(F.col(n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(F.col(n)) - 1))
    columns = ("key", "node", "own", "rest", "fp", "size", "keys")
    left = held.where("rest").select(*columns, F.lit(True).alias("turned"), own_part("n_rest").alias("i"), every("n").alias("j"))
    right = held.select(*columns, F.lit(False).alias("turned"), every("n_rest").alias("i"), own_part("n").alias("j"))
    each = F.struct("turned", "rest", "node", "own", "size", "fp", "keys")
    cells = left.unionByName(right).groupBy("key", "i", "j").agg(F.collect_list(each).alias("c"))
    cells = cells.select("key", *(F.col(f"c.{x}").alias(x) for x in ("turned", "rest", "node", "own", "size", "fp", "keys")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, turned, rest, node, own, size, fp, keys in batch.itertuples(index=False):
                turned, rest, size = np.asarray(turned, dtype=bool), np.asarray(rest, dtype=bool), np.asarray(size)
                node, own = np.asarray(node), np.asarray(own)
                bits = np.frombuffer(b"".join(fp), dtype=np.uint64).reshape(len(node), -1)
                other = np.nonzero(~turned)[0]
                found, all_keys = [], np.zeros((len(node), max(map(len, keys))), dtype=np.int64)
                for row, k in zip(all_keys, keys, strict=True):
                    row[: len(k)] = k
                for k in np.nonzero(turned)[0].tolist():
                    least, most = np.minimum(size[k], size[other]), np.maximum(size[k], size[other])
                    ok = (own[other] != own[k]) & (~rest[other] | (node[k] < node[other])) & (least >= similarity * most - 1e-9)
                    at = other[ok]
                    if len(at):
                        apart = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)
                        at = at[(apart <= limit) | (most[ok] < FEW)]
                        first = all_keys[k][(all_keys[at] == all_keys[k]).argmax(axis=1)]
                        found += [(int(node[k]), b) for b in node[at[first == key]].tolist()]
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

    return cells.mapInPandas(compare, "a long, b long").distinct()


def _similar(likely: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have the similarity."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "hashes": [np.unique(shingle_hashes(t, words)).astype(np.int64) for t in batch["text"]]})

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            either = len(x) + len(y) - shared
            out.append(shared >= similarity * either - 1e-9)
        return pd.Series(out, dtype=bool)

    likely = written(likely, "likely")
    needed = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
    where = nodes.join(needed, "node").select("node", F.col("place.doc_id").alias("id"), F.col("place.text_key").alias("key"))
    found = rows.join(where, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).select("node", "text").dropDuplicates(["node"])
    sets = written(found.mapInPandas(whole, "node long, hashes array<long>"), "shingles")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    return written(likely.join(side("a"), "a").join(side("b"), "b").where(similar("of_a", "of_b")).select("a", "b"), "similar")
