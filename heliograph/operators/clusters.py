"""Face clustering and what follows from it."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import landed
from .ordered import running


#: Undecided detections of a job that are walked in a round, and detections that meet a round's leaders in one task.
BLOCK, CHUNK = 1_024, 20_000
#: Pivots of an index and candidates that they are taken from; angles closer than the slack count as equal.
PIVOTS, SAMPLE, SLACK = 32, 2_048, 1e-6
#: Candidates, and queries, that meet as matrices in one task; queries multiplied at a time; products closer than TIE are decided by the exact cosine, so many numbers at a time.
MEET, TILE, TIE, EXACT = 8_192, 64, 1e-9, 1 << 22


def units(vectors: pd.Series | list, width: int | None = None) -> np.ndarray:
    """Unit vectors as rows; a null or zero vector stays zero."""
    width = width or max((len(v) for v in vectors if v is not None), default=0)
    out = np.array([np.zeros(width) if v is None else v for v in vectors], dtype=np.float64).reshape(len(vectors), width)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def leader_clusters(detections: DataFrame, job: str, order: list[str], vector: str, threshold: float = 0.6, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(job, order..., cluster): each detection, in order, joins the first cluster whose first member is as similar as the threshold, else founds one.

    Leaders are the first set in order of which no two are similar.  They are found in rounds: of each job the first
    ``block`` undecided detections are walked in order, which gives the round's leaders; then all undecided ones, in chunks of
    about ``chunk``, meet these and join the first that is similar.  What an earlier leader takes is gone before, so the result is
    that of one walk, and no task holds a job or all of its leaders.  A null or zero vector is similar to nothing (over a threshold of 0) and leads a cluster of its own.
    """
    placed = running(detections.select(F.col(job).alias("job"), F.struct(*order).alias("row"), F.col(vector).cast("array<double>").alias("v"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order))), ["job"], [f"o{i}" for i in range(len(order))], place="seq")
    undecided = placed.select("job", "row", "v", "seq", F.lit(0).cast("long").alias("base"), F.lit(None).cast("long").alias("cluster"))
    state = ", ".join(f"{c} {t}" for c, t in undecided.dtypes if c != "row")
    kind = dict(detections.select(job).dtypes)[job]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        unit = units(rows["v"])
        near = unit @ unit.T >= threshold
        alone = ~near.diagonal()  # zero vectors: no leader takes them
        lead: list[int] = []
        for i in range(len(rows)):
            if alone[i] or not near[i, lead].any():
                lead.append(i)
        first = rows.iloc[lead]
        return pd.DataFrame({"job": first["job"], "seq": first["seq"], "v": first["v"], "cluster": first["base"] + np.arange(len(first))})

    def meet(rows: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("cluster")
        width = max((len(v) for v in [*rows["v"], *leaders["v"]] if v is not None), default=0)
        near = units(rows["v"], width) @ units(leaders["v"], width).T >= threshold
        own = rows["seq"].to_numpy()[:, None] == leaders["seq"].to_numpy()[None, :]
        near = np.where(own.any(axis=1, keepdims=True), own, near)
        hit = near.any(axis=1)
        found = leaders["cluster"].to_numpy()[near.argmax(axis=1)] if len(leaders) else np.zeros(len(rows), dtype=np.int64)
        return rows.assign(cluster=pd.array(np.where(hit, found, 0), dtype="Int64").copy(), base=rows["base"] + len(leaders)).assign(cluster=lambda x: x["cluster"].mask(~hit))[["job", "v", "seq", "base", "cluster"]]

    undecided = undecided.drop("row")
    found = []
    while True:
        first = undecided.withColumn("nth", F.row_number().over(Window.partitionBy("job").orderBy("seq"))).where(F.col("nth") <= block).drop("nth", "cluster")
        leaders = landed(first.groupBy("job").applyInPandas(walk, f"job {kind}, seq long, v array<double>, cluster long"))
        salts = undecided.groupBy("job").agg(F.ceil(F.count("*") / chunk).cast("int").alias("salts"))
        spread = lambda df: df.join(salts.withColumnRenamed("job", "of"), F.col("job").eqNullSafe(F.col("of"))).drop("of")
        left = spread(undecided).withColumn("salt", F.pmod(F.xxhash64("seq"), "salts").cast("int")).drop("salts")
        right = spread(leaders).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        met = landed(left.groupBy("job", "salt").cogroup(right.groupBy("job", "salt")).applyInPandas(meet, state))
        found.append(met.where("cluster is not null").select("job", "seq", "cluster"))
        undecided = met.where("cluster is null")
        if undecided.isEmpty():
            break
    named = reduce(DataFrame.unionByName, found).select(F.col("job").alias("__job"), F.col("seq").alias("__seq"), "cluster")
    rows = placed.select("job", "row", "seq").join(named, F.col("job").eqNullSafe(F.col("__job")) & (F.col("seq") == F.col("__seq")))
    return rows.select(F.col("job").alias(job), "row.*", "cluster")


def one_each(detections: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Clustering switched off: each detection is a cluster."""
    return detections.withColumn("cluster", F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1)


def representatives(members: DataFrame, keys: list[str], quality: str, order: str, carry: list[str]) -> DataFrame:
    """Of each cluster the member of highest quality, the first in order on ties, and the cluster's size."""
    best = F.max_by(F.struct(F.col(order), F.col(quality), *carry), F.struct(F.col(quality), -F.col(order)))
    return members.groupBy(*keys).agg(best.alias("best"), F.count("*").alias("n_members")).select(*keys, "best.*", "n_members")


def face_report(members: DataFrame, job: str, frame: str) -> DataFrame:
    return members.groupBy(job).agg(F.countDistinct("cluster").alias("unique_faces"), F.count("*").alias("total_detections"), F.countDistinct(frame).alias("frames_processed"))


def _pivots(candidates: DataFrame, n: int, sample: int) -> np.ndarray:
    """Up to n unit vectors far apart, of ``sample`` candidates: each next one is the farthest from those before it."""
    some = candidates.orderBy(F.xxhash64("candidate_id"), "candidate_id").limit(sample).select("c").toPandas()["c"]
    widths = [len(v) for v in some]
    width = max(set(widths), key=widths.count, default=0)
    unit = units([v for v in some if len(v) == width], width)
    unit = unit[np.isfinite(unit).all(axis=1) & unit.any(axis=1)]
    if not len(unit):
        return np.zeros((0, width))
    found, nearest = [0], unit @ unit[0]
    while len(found) < min(n, len(unit)) and nearest.min() < 1 - 1e-9:
        found.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[found[-1]])
    return unit[found]


def _rows(table: pa.Table, names: list[str], vector: str) -> tuple[list[np.ndarray], pa.Array, np.ndarray]:
    """Columns as numbers (NaN for null), and the vectors with their lengths."""
    column = table.column(vector).combine_chunks()
    return [table.column(n).to_numpy() for n in names], column, pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed left to right as `vectors.dot` does it."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _meet(asked: pa.Table, others: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of queries, places of candidates, similarities) of each query's best over the threshold in its part g, and the pairs compared.

    A tile of queries times the candidates that their angles allow is one matrix product; only candidates that it puts within TIE of
    the best, or can't tell (numbers too large or small), get the exact cosine, and among equal ones the first in order stays.
    """
    rank = pc.rank(others.column("ord").combine_chunks(), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
    (qg, own, limit), qv, qw = _rows(asked, ["g", "own", "limit"], "q")
    (cg, angle), cv, cw = _rows(others, ["g", "angle"], "c")
    q_order, c_order = np.lexsort((own, qw, qg)), np.lexsort((angle, cw, cg))
    cut = lambda order, g, w: np.split(order, np.nonzero(np.diff(g[order]) | np.diff(w[order]))[0] + 1) if len(order) else []
    there = {(cg[rows[0]], cw[rows[0]]): rows for rows in cut(c_order, cg, cw)}
    found, pairs = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))], 0
    for mine in cut(q_order, qg, qw):
        rows = there.get((qg[mine[0]], width := int(qw[mine[0]])))
        if rows is None:
            continue
        q, c, angles = _matrix(qv, mine, width), _matrix(cv, rows, width), angle[rows]
        with np.errstate(all="ignore"):
            q2, c2 = _dots(q, q), _dots(c, c)
            told = lambda n2: (n2 == 0) | (n2 > 1e-280) & (n2 < 1e280)
            q_unit, c_unit = (np.where((told(n2) & (n2 > 0))[:, None], m / np.sqrt(n2)[:, None], 0.0) for m, n2 in ((q, q2), (c, c2)))
            low, high = (np.where(np.isnan(own[mine]), end, own[mine] + way * limit[mine]) for end, way in ((-np.inf, -1), (np.inf, 1)))
            for at in range(0, len(mine), TILE):
                tile = slice(at, at + TILE)
                span = slice(np.searchsorted(angles, low[tile].min()), np.searchsorted(angles, high[tile].max(), "right"))
                sims = q_unit[tile] @ c_unit[span].T
                pairs += sims.size
                sims[~told(q2[tile])] = np.nan
                sims[:, ~told(c2[span])] = np.nan
                top = np.fmax.reduce(sims, axis=1, initial=threshold)
                i, j = np.nonzero(~(sims < top[:, None] - TIE))
                i, j = i + at, j + span.start
                for some in range(0, len(i), step := max(1, EXACT // max(1, width))):
                    x, y = i[some : some + step], j[some : some + step]
                    s = np.where((q2[x] == 0) | (c2[y] == 0), 0.0, _dots(q[x], c[y]) / (np.sqrt(q2[x]) * np.sqrt(c2[y])))
                    over = ~(s <= threshold)  # NaN counts as the highest, as in Spark
                    x, y, s = x[over], y[over], s[over]
                    first = np.lexsort((rank[rows[y]], -np.where(np.isnan(s), np.inf, s), x))
                    first = first[np.nonzero(np.diff(x[first], prepend=-1))[0]]
                    found.append((mine[x[first]], rows[y[first]], s[first]))
    return (*(np.concatenate(parts) for parts in zip(*found, strict=True)), pairs)


def best_matches(queries: DataFrame, candidates: DataFrame, key: str, threshold: float = 0.6, pivots: int = PIVOTS, sample: int = SAMPLE, compared: tuple[Observation, Observation] | None = None, block: int = MEET) -> DataFrame:
    """For each query (query_id, key, vector) the candidate of its key (candidate_id, ord, vector) of highest cosine, strictly over the threshold; the earliest on ties.

    Exact, without comparing all: of equal vectors the earliest counts, candidates belong to the part of their nearest pivot (``pivots`` of them, from a sample of ``sample`` candidates),
    and a part knows its range of angles from its pivot. By the triangle inequality of angles a query knows how near a part can come. It meets
    the part of the nearest pivot first, then those parts, and of these the candidates, that can still beat what it has. Unclustered vectors skip little,
    so queries and candidates meet as matrices: in blocks of about ``block`` of each, so that no task holds a key or a part.
    Null, NaN and differently long vectors match nothing; a zero vector has the similarity 0. compared: two observations that count the pairs of both rounds.
    """
    whole = lambda v: F.forall(F.col(v).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
    told = candidates.where(whole("vector")).select(F.col(key).alias("key"), "candidate_id", "ord", F.col("vector").cast("array<double>").alias("c"))
    earliest = F.max_by(F.struct("candidate_id", "ord"), F.struct(-F.col("ord"))).alias("one")  # of copies; a null order comes last
    told = landed(told.groupBy("key", "c").agg(earliest).select("key", "one.candidate_id", "one.ord", "c"), "told")
    chosen = _pivots(told, pivots, sample)

    def angles(vectors: pd.Series) -> np.ndarray:
        """To each pivot; NaN where a vector has none."""
        out = np.full((len(vectors), len(chosen)), np.nan)
        fit = np.array([v is not None and len(v) == chosen.shape[1] for v in vectors], dtype=bool)
        unit = units(vectors[fit], chosen.shape[1])
        out[fit] = np.where(unit.any(axis=1, keepdims=True), np.arccos(np.clip(unit @ chosen.T, -1, 1)), np.nan)
        return out

    @F.pandas_udf("array<double>")
    def to_pivots(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(a).any() else a for a in angles(vectors)], dtype=object)

    @F.pandas_udf("part int, angle double")
    def nearest_pivot(vectors: pd.Series) -> pd.DataFrame:
        a = angles(vectors)
        off = np.isnan(a).any(axis=1) | (a.shape[1] == 0)  # a part of its own that every query meets
        a = np.where(off[:, None], 0.0, a)
        part = a.argmin(axis=1) if a.shape[1] else np.zeros(len(a), dtype=int)
        return pd.DataFrame({"part": np.where(off, -1, part), "angle": a[np.arange(len(a)), part] if a.shape[1] else np.zeros(len(a))})

    indexed = landed(told.withColumn("p", nearest_pivot("c")).select("key", "candidate_id", "ord", "c", "p.part", "p.angle"), "index")
    sizes = indexed.groupBy("key", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    sizes = landed(sizes.withColumns({"blocks": F.ceil(F.col("n") / block).cast("int"), "g": F.monotonically_increasing_id()}), "parts")
    bins = -(-(sizes.agg(F.sum("n")).head()[0] or 1) // block)  # small parts share a task
    parts = sizes.groupBy("key").agg(F.collect_list(F.struct("part", "low", "high", "blocks", "g")).alias("parts"))
    asked = queries.where(whole("vector")).select(F.col(key).alias("key"), "query_id", F.col("vector").cast("array<double>").alias("q"), to_pivots("vector").alias("to")).join(parts, "key")
    own = lambda p: F.when(p["part"] >= 0, F.get(F.col("to"), p["part"]))  # noqa: E731  null: no bound
    gap = lambda p: F.greatest(F.lit(0.0), own(p) - p["high"], p["low"] - own(p))
    within = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    near = F.filter(F.transform("parts", lambda p: F.struct(F.coalesce(own(p), F.lit(math.pi)).alias("far"), gap(p).alias("gap"), own(p).alias("own"), p["g"].alias("g"), p["blocks"].alias("blocks"))), lambda p: p["gap"] <= within)
    asked = landed(asked.select("key", "query_id", "q", F.array_sort(near).alias("near")).where(F.size("near") > 0), "asked")
    rows_of = asked.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"))
    grid = ["bin", "q_block", "block"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n, *of: F.pmod(F.xxhash64(*of), n).cast("int")
    laid = indexed.join(sizes.select("key", "part", "g", "blocks"), ["key", "part"]).join(rows_of, "key")
    laid = laid.select(spot(F.lit(bins), "g").alias("bin"), each("q_blocks").alias("q_block"), spot(F.col("blocks"), "candidate_id", "ord", "angle").alias("block"), "g", "candidate_id", "ord", "c", "angle")
    ids = [asked.schema["query_id"], indexed.schema["candidate_id"], indexed.schema["ord"]]
    schema = StructType([StructField(f.name, f.dataType) for f in ids] + [StructField("similarity", DoubleType()), StructField("pairs", LongType())])

    def compare(some: pa.Table, others: pa.Table) -> pa.Table:
        """Each query's best here, and a row without ids that counts the pairs."""
        i, j, s, pairs = _meet(some, others, threshold) if some.num_rows and others.num_rows else ([], [], [], 0)
        i, j = (pa.array([*x, None], pa.int64()) for x in (i, j))
        columns = [some.column("query_id").take(i), others.column("candidate_id").take(j), others.column("ord").take(j)]
        return pa.table([*columns, pa.array([*s, None], pa.float64(), from_pandas=False), pa.array([None] * (len(i) - 1) + [pairs], pa.int64())], names=schema.names)

    def meet(some: DataFrame, limit: Column, seen: Observation | None) -> DataFrame:
        """The best over the threshold of the candidates in the parts p, as far as their own angles allow it."""
        some = some.join(rows_of, "key").select("query_id", "q", "p.own", "p.g", "p.blocks", limit.alias("limit"), spot(F.col("q_blocks"), "query_id").alias("q_block"))
        some = some.select(spot(F.lit(bins), "g").alias("bin"), "q_block", each("blocks").alias("block"), "g", "query_id", "q", "own", "limit")
        scored = some.groupBy(*grid).cogroup(laid.groupBy(*grid)).applyInArrow(compare, schema)
        scored = scored.observe(seen, F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")) if seen else scored
        return _best(scored.where("pairs is null").drop("pairs"))

    first = landed(meet(asked.withColumn("p", F.get("near", F.lit(0))), F.lit(within), compared and compared[0]), "first")
    left = asked.join(first.select(F.col("query_id").alias("id"), F.col("similarity").alias("have")), F.col("query_id").eqNullSafe(F.col("id")), "left").drop("id")
    limit = F.when(F.col("have").isNull(), within).otherwise(F.acos(F.least(F.lit(1.0), "have")) + SLACK)
    rest = left.withColumn("p", F.explode(F.filter(F.slice("near", 2, pivots + 1), lambda p: p["gap"] <= limit)))
    return _best(first.unionByName(meet(rest, limit, compared and compared[1]))).select("query_id", "candidate_id", "similarity")


def _best(scored: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("candidate_id", "ord", "similarity"), F.struct("similarity", -F.col("ord")))
    return scored.groupBy("query_id").agg(best.alias("m")).select("query_id", "m.*")


def match_truth(truth: DataFrame, found: DataFrame, frame: list[str], overlap) -> DataFrame:
    """n_truth, n_found, n_matched, precision, recall, f1; overlap is the Column condition of a match."""
    met = truth.join(found, frame).where(overlap)
    told = lambda rows, kind: rows.select(F.lit(kind).alias("kind"))
    every = told(truth, "truth").unionByName(told(found, "found")).unionByName(told(met.select("truth_id").distinct(), "met"))
    counts = every.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("truth", "n_truth"), ("found", "n_found"), ("met", "n_matched"))))
    share = lambda n: F.when(F.col(n) > 0, F.col("n_matched") / F.col(n)).otherwise(0.0)
    rated = counts.withColumns({"precision": share("n_found"), "recall": share("n_truth")})
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
