"""Running sums, trailing means and rows kept apart, over keys of any size.

A window over a key puts all of its rows in one task.  Here rows are laid in ranges of (key, order), each
range is summed by itself, and the sums of a key's earlier ranges are added: two levels of prefix sums, in as many tasks as there are ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import landed

#: Rows of a key in a block of `trailing`.
BLOCK = 65_536


def _same(left: DataFrame, right: DataFrame, names: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in names))


def running(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, str] | None = None, place: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with running sums (new column to column) and the 1-based place by the order within a key.

    As windows over the key would give them, but a key's rows are spread over ranges.  Nulls add nothing (a sum is null while there are
    only nulls); rows equal in key and order stand in one range, in any order among themselves.
    """
    sums = sums or {}
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = landed(rows.repartitionByRange(parts, *key, *order).withColumn("__part", F.spark_partition_id()))
    whole = laid.groupBy(*key, "__part").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__sum_{new}") for new, c in sums.items()))
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    names = [f"__k{i}" for i in range(len(key))]
    before = whole.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True)), F.col("__part").alias("__at"), F.sum("__n").over(earlier).alias("__n"), *(F.sum(f"__sum_{new}").over(earlier).alias(f"__before_{new}") for new in sums))
    own = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({new: F.sum(c).over(own) for new, c in sums.items()} | ({place: F.row_number().over(own)} if place else {}))
    joined = local.join(before, _same(local, before, [*zip(key, names, strict=True), ("__part", "__at")]))
    total = lambda new: F.when(F.col(new).isNull(), F.col(f"__before_{new}")).otherwise(F.col(new) + F.coalesce(f"__before_{new}", F.lit(0)))
    out = {new: total(new) for new in sums} | ({place: F.col(place) + F.coalesce("__n", F.lit(0))} if place else {})
    return joined.withColumns(out).drop("__part", "__at", "__n", *names, *(f"__before_{new}" for new in sums))


def trailing(rows: DataFrame, key: list[str], order: list[str], samples: int, means: dict[str, str], block: int = BLOCK) -> DataFrame:
    """rows with means (new column to column) of the last ``samples`` rows of their key up to each, as a window over the key would give them.

    A key's rows are cut by their places into blocks of ``block`` rows (``samples`` at least).  The last ``samples`` - 1 rows of a block also go to the
    next one, ahead of its own, so each block is a task's window and no task holds a key.
    """
    size = max(block, samples)
    at = F.col("__place") - 1
    own = F.floor(at / size).cast("long")
    here = F.struct(own.alias("block"), F.lit(True).alias("own"))
    ahead = F.struct((own + 1).alias("block"), F.lit(False).alias("own"))
    laid = running(rows, key, order, place="__place").withColumn("__in", F.explode(F.when(F.pmod(at, F.lit(size)) > size - samples, F.array(here, ahead)).otherwise(F.array(here))))
    w = Window.partitionBy(*key, "__in.block").orderBy("__place").rowsBetween(1 - samples, 0)
    return laid.withColumns({new: F.avg(c).over(w) for new, c in means.items()}).where("__in.own").drop("__in", "__place")


def kept_apart(marks: DataFrame, key: str, order: list[str], time: str, least: float) -> DataFrame:
    """The marks that a walk in order keeps: the first of each key, then always the first at least ``least`` after the one kept last.

    Without a walk: each mark points to the first mark at ``time + least`` or later, and what the first one reaches is found by doubling the
    pointers, in as many rounds as the longest chain has binary digits.  A mark without a time is never kept.
    """
    if least <= 0:
        return marks.where(F.col(time).isNotNull())
    numbered = landed(marks.where(F.col(time).isNotNull()).withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(time, *order))))
    told = numbered.select(F.col(key).alias("k"), F.col("__i").alias("i"), F.col(time).alias("t"))
    # from the latest on: the last mark seen before a place asked for is the first one at or after it
    both = told.select("k", "t", F.lit(0).alias("asks"), F.col("i").alias("own"), F.col("i").alias("mark")).union(told.select("k", F.col("t") + least, F.lit(1), "i", F.lit(None).cast("int")))
    backward = Window.partitionBy("k").orderBy(F.desc("t"), "asks", F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    pointers = landed(both.withColumn("to", F.last("mark", ignorenulls=True).over(backward)).where("asks = 1 and to is not null").select("k", F.col("own").alias("i"), "to"))
    reached = told.where("i = 1").select("k", "i")
    while not pointers.isEmpty():
        on = lambda a, b, i: a["k"].eqNullSafe(b["k"]) & (a[i] == b["i"])
        reached = landed(reached.union(reached.join(pointers, on(reached, pointers, "i")).select(reached["k"], F.col("to").alias("i"))).distinct())
        step = pointers.select(F.col("k").alias("k2"), F.col("i").alias("i2"), F.col("to").alias("higher"))
        pointers = landed(pointers.join(step, pointers["k"].eqNullSafe(F.col("k2")) & (F.col("to") == F.col("i2"))).select("k", "i", F.col("higher").alias("to")))
    kept = reached.select(F.col("k").alias("__k"), F.col("i").alias("__reached"))
    return numbered.join(kept, numbered[key].eqNullSafe(kept["__k"]) & (numbered["__i"] == kept["__reached"]), "left_semi").drop("__i")
