"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines gives each place between lines a number; a chunk
ends where that number is smaller than at the places before and after.  A boundary thus depends on the
two lines before and after it alone: an inserted or deleted line shifts no other, and a chunk has two
lines at least.  A line of LONG words or more is a chunk of its own.  Blank lines belong to no chunk.

Chunks that occur again anywhere in the corpus are repeated.  The first and last lines of a shared
passage stand in chunks with a document's own lines, so the pairs of neighbouring lines are looked up as
well.  Each repeated chunk or pair points to its first occurrence (the smallest doc_id, the first place there).  A run of pairs goes like a
chunk if it has LONG words or more and its pairs point to places that follow one another in one document: so that
document holds the run whole.  Pairs whose first occurrences lie apart make no run.  Runs reach through chunks, so a chunk inside a
passage leaves none of its edges behind; chunks that runs cover point to nothing of their own.

Lines that a chunk or run points to stay where they are, whatever else covers them: what goes is still somewhere in the
corpus, whole and in order.  No other line goes.

Only 128-bit hashes are counted over the corpus; of those seen twice the bytes are compared, and a hash
that stands for different bytes removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_tables, join_counted, small_batches, table, tables_written, texts, trimmed, written

#: A line of so many words is a passage by itself.
LONG = 30
#: Words in a chunk of several lines, at least.
LEAST = 8
MASK = (1 << 64) - 1
#: Candidates that a worker gathers before it passes them on.
PIECE = 20_000


def worded_lines(text: str) -> tuple[list[str], list[int], list[int]]:
    """The lines of a text, the places of those that hold a word, and how many words these have."""
    lines = text.split("\n")
    counts = [len(line.split()) for line in lines]
    at = [i for i, n in enumerate(counts) if n]
    return lines, at, [counts[i] for i in at]


def chunks(lines: list[bytes], words: list[int]) -> list[tuple[int, int]]:
    """(first, end) of the chunks of lines that hold words."""
    import xxhash

    n = len(lines)
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    rolled = []
    for a, b in zip(hashes, hashes[1:], strict=False):
        r = (a * 0x9E3779B185EBCA87 + b) & MASK
        rolled.append(r ^ (r >> 33))
    ends = [i + 1 for i in range(n - 1) if words[i] >= LONG or words[i + 1] >= LONG or (0 < i < n - 2 and rolled[i - 1] > rolled[i] < rolled[i + 1])]
    return list(zip([0, *ends], [*ends, n], strict=True)) if n else []


def candidates(text: str) -> list[tuple[int, int, bool, int, int, bytes]]:
    """(first, end, is a chunk, words of the first and of the last line, bytes) of the chunks and pairs of a text; places count the lines that hold words."""
    lines, at, words = worded_lines(text)
    raw = [lines[i].encode("utf-8", "surrogatepass") for i in at]
    cut = {c for c in chunks(raw, words) if sum(words[c[0] : c[1]]) >= (LEAST if c[1] - c[0] > 1 else LONG)}
    spans = sorted(cut | {(i, i + 2) for i in range(len(raw) - 1)})
    return [(a, b, (a, b) in cut, words[a], words[b - 1], b"\n".join(raw[a:b])) for a, b in spans]


FOUND = "doc_id long, text_key long, first int, end int, own boolean, head int, tail int, h1 long, h2 long"


def candidate_rows(docs: DataFrame) -> DataFrame:
    """A row for each candidate of rows (doc_id, text_key, text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def made(rows: list, digests: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "text_key", "first", "end", "own", "head", "tail"])
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            out["doc_id"], out["h1"], out["h2"] = out["doc_id"].astype("Int64"), both[:, 0], both[:, 1]
            return out

        rows, digests = [], []
        for batch in trimmed(batches):
            for doc, key, text in zip(batch["doc_id"].astype("Int64"), batch["text_key"], batch["text"], strict=True):
                for *span, body in candidates(text):
                    rows.append((doc, key, *span))
                    digests.append(xxhash.xxh128_digest(body))
                if len(rows) >= PIECE:
                    yield made(rows, digests)
                    rows, digests = [], []
        if rows:
            yield made(rows, digests)

    return docs.mapInPandas(cut, FOUND)


def ranges(marks: list[dict]) -> list[tuple[int, int, int, int, int]]:
    """(first, end, the document, its row and the place where they stand first) of the lines that go: runs of repeated pairs, then repeated chunks that runs don't cover."""
    gone = sorted((m for m in marks if m["gone"]), key=lambda m: (m["first"], m["end"]))
    pairs = {m["first"]: m for m in gone if m["end"] - m["first"] == 2}
    found, i = [], -1
    for start in sorted(pairs):
        if start < i:
            continue
        m, n, words = pairs[start], 1, pairs[start]["head"] + pairs[start]["tail"]
        where = (m["w_place"], m["w_key"])
        while (more := pairs.get(start + n)) and (more["w_place"], more["w_key"]) == where and more["w_first"] == m["w_first"] + n:
            words += more["tail"]
            n += 1
        i = start + n  # the run's last line, which may head another run
        if words >= LONG:
            found.append((start, start + n + 1, *where, m["w_first"]))
            i += 1
    taken = {i for a, b, *_ in found for i in range(a, b)}
    return found + [(m["first"], m["end"], m["w_place"], m["w_key"], m["w_first"]) for m in gone if m["own"] and not taken.issuperset(range(m["first"], m["end"]))]


POINTED = "array<struct<w_place:long,w_key:int,w_first:int,n:int>>"


def pointed(marks: str) -> Column:
    """The places that a document's ranges point to."""

    @F.pandas_udf(POINTED)
    def point(batch: pd.Series) -> pd.Series:
        return pd.Series([[{"w_place": p, "w_key": k, "w_first": f, "n": b - a} for a, b, p, k, f in ranges(list(g))] for g in batch], dtype=object)

    return point(marks)


def clashing(marked: DataFrame) -> DataFrame:
    """h1, h2 that stand for different bytes, of rows (text, marks)."""

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in trimmed(batches):
            for text, marks in zip(batch["text"], batch["marks"], strict=True):
                lines, at, _ = worded_lines(text)
                rows += [(m["h1"], m["h2"], "\n".join(lines[i] for i in at[m["first"] : m["end"]])) for m in marks]
                if len(rows) >= PIECE:
                    yield pd.DataFrame(rows, columns=["h1", "h2", "body"])
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["h1", "h2", "body"])

    found = marked.mapInPandas(bodies, "h1 long, h2 long, body string").groupBy("h1", "h2", "body").agg(F.count("*").alias("n"))
    return found.groupBy("h1", "h2").agg(F.count("*").alias("bodies")).where("bodies > 1").drop("bodies")


APPLIED = "kept string, n_removed long, words_removed long, lines_removed long"


def without(text: Column, marks: Column, kept: Column) -> Column:
    @F.pandas_udf(APPLIED)
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, found, stay in trimmed(batches):
            yield pd.DataFrame([_without(t, ranges(list(g)), [] if k is None else [(x["w_first"], x["n"]) for x in k]) for t, g, k in zip(bodies, found, stay, strict=True)], columns=["kept", "n_removed", "words_removed", "lines_removed"])

    return apply(text, marks, kept)


def _without(text: str, gone: list[tuple], stay: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without the ranges of lines that go, but for those that stay, and how many stretches, words and lines these are."""
    lines, at, words = worded_lines(text)
    drop = [False] * len(at)
    for first, end, *_ in gone:
        drop[first:end] = [True] * (end - first)
    for first, n in stay:
        drop[first : first + n] = [False] * len(drop[first : first + n])
    if not any(drop):
        return text, 0, 0, 0
    keep = [True] * len(lines)
    for k, i in enumerate(at):
        if drop[k]:
            keep[i] = False
            if k + 1 < len(at) and drop[k + 1]:  # blank lines inside a stretch go with it
                keep[i : at[k + 1]] = [False] * (at[k + 1] - i)
    stretches = sum(d and (k == 0 or not drop[k - 1]) for k, d in enumerate(drop))
    kept = "" if all(drop) else "\n".join(line for line, stays in zip(lines, keep, strict=True) if stays)
    return kept, stretches, sum(n for n, d in zip(words, drop, strict=True) if d), sum(drop)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """row (a struct of the input's columns), kept (text without repeated lines) and lines (counts of stretches, words, lines removed).

    A null text is empty and stays null in its row; an empty table gives no rows.  Rows equal in doc_id and text are one
    document and get the same result; what different rows of one doc_id share stays in each.  A null doc_id counts as
    larger than any other; what only such rows hold stays.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(body).alias("key"))
    mark = tables_written()
    found = written(candidate_rows(rows.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), body.alias("text"))), "line-chunks")
    none = F.lit((1 << 63) - 1)
    place = F.coalesce("doc_id", none)
    counts = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(place.alias("p"), "text_key", "first")).alias("w")).where("n > 1")
    short = lambda key: F.pmod(F.col(key), F.lit((1 << 31) - 1)).cast("int")  # noqa: E731  tells rows of one doc_id apart
    counts = written(counts.select("h1", "h2", "n", F.col("w.p").alias("w_place"), F.col("w.text_key").alias("w_row"), F.col("w.first").alias("w_first")), "repeated-chunks")
    later = (place > F.col("w_place")) | ((place == F.col("w_place")) & (F.col("text_key") == F.col("w_row")) & (F.col("first") > F.col("w_first")))
    marks = join_counted(found, counts, ["h1", "h2"]).withColumns({"gone": later, "w_key": short("w_row")})
    each = F.struct("first", "end", "own", "head", "tail", "gone", "w_place", "w_key", "w_first", "h1", "h2")
    per_doc = written(marks.select("doc_id", "text_key", each.alias("m")).groupBy("doc_id", "text_key").agg(F.collect_set("m").alias("marks")), "line-marks", "zstd")
    asked = per_doc.select(F.explode(pointed("marks")).alias("p")).select("p.*").distinct()
    stay = asked.groupBy("w_place", "w_key").agg(F.collect_list(F.struct("w_first", "n")).alias("stay"))
    per_doc = per_doc.join(stay, (F.coalesce("doc_id", none) == F.col("w_place")) & (short("text_key") == F.col("w_key")), "left").drop("w_place", "w_key")
    joined = written(rows.join(per_doc, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left").select("row", "marks", "stay"), "marked-lines", "zstd")
    drop_tables(docs.sparkSession, mark, keep=1)  # chunks and counts have done their work
    met = joined.where("marks is not null")
    clash = clashing(met.select(body.alias("text"), "marks")).checkpoint()
    if not clash.isEmpty():  # only for a collision of 128-bit hashes
        numbered = met.withColumn("no", F.monotonically_increasing_id())
        honest = numbered.select("no", F.explode("marks").alias("m")).select("no", "m", "m.h1", "m.h2").join(clash, ["h1", "h2"], "left_anti").groupBy("no").agg(F.collect_list("m").alias("honest"))
        met = numbered.join(honest, "no", "left").select("row", F.coalesce("honest", F.slice("marks", 1, 0)).alias("marks"), "stay")
    changed = met.select("row", without(body, F.col("marks"), F.col("stay")).alias("lines")).select("row", F.col("lines.kept").alias("kept"), F.struct("lines.n_removed", "lines.words_removed", "lines.lines_removed").alias("lines"))
    zero = F.lit(0).cast("long")
    same = joined.where("marks is null").select("row", body.alias("kept"), F.struct(zero.alias("n_removed"), zero.alias("words_removed"), zero.alias("lines_removed")).alias("lines"))
    return changed.unionByName(same)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(texts(table(spark, sf_dir, "documents")))
    return out.select("row.doc_id", "lines.n_removed", "lines.words_removed", "lines.lines_removed", F.length("kept").cast("long").alias("kept_chars"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
