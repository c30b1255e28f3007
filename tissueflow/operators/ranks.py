"""Exact ranks and percentiles of a whole table without one task that holds it: rows are dealt to ranges of the key, whose sizes say
where each range begins."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissueflow.durable import saved

#: Ranges that a table is dealt to.
RANGES = 64


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    return saved(df.repartitionByRange(RANGES, *keys).withColumn("__range", F.spark_partition_id()))


def positions(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """``df`` with ``position``, from 1 in the order of ``keys``, and the number of its rows."""
    dealt = _dealt(df, list(keys))
    before, n = [], 0
    for r in sorted(dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()):  # ranges
        before += [F.lit(r["__range"]), F.lit(n)]
        n += r["n"]
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    start = F.element_at(F.create_map(*before), F.col("__range")) if before else F.lit(0)
    return dealt.withColumn("position", (start + at).cast("long")).drop("__range"), n


def sums_before(df: DataFrame, group: str, key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``group`` with a lesser ``key``, of which each row has another."""
    dealt = _dealt(df, [group, key])
    own = dealt.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__own")).agg(F.sum(value).alias("n"))  # a row a range and group
    earlier = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select("__group", "__own", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("__group").orderBy("__own"))), F.lit(0)).alias("__start"))
    t = dealt.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__own")))
    within = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("__range", group).orderBy(key))), F.lit(0))
    return t.withColumn(name, F.col("__start") + within).select(*df.columns, name)


def tile(position: Column, n: int, tiles: int) -> Column:
    """The tile of a position among ``n`` as SQL's ntile deals them: the first ones hold one more."""
    size, more = divmod(n, tiles)
    wide = F.floor((position - 1) / (size + 1)) + 1
    return F.when(position <= more * (size + 1), wide).otherwise(F.floor((position - 1 - more * (size + 1)) / max(size, 1)) + 1 + more).cast("int")


def percentiles(df: DataFrame, column: str, **shares: float) -> DataFrame:
    """One row, a column for each of ``shares``: the percentiles of ``column`` as SQL's percentile gives them, nulls left out."""
    counted = _dealt(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), ["v"])
    starts, n = {}, 0
    for r in sorted(counted.groupBy("__range").agg(F.sum("n").alias("n")).collect()):  # ranges
        starts[r["__range"]] = (n, n + r["n"])
        n += r["n"]
    ends = {k: (floor(p * (n - 1)), ceil(p * (n - 1))) for k, p in shares.items()} if n else {k: (0, 0) for k in shares}
    asked = [g for g, (lo, hi) in starts.items() if any(lo <= e < hi for pair in ends.values() for e in pair)]
    upto = F.sum("n").over(Window.partitionBy("__range").orderBy("v")) + F.element_at(F.create_map(*(F.lit(x) for g in asked for x in (g, starts[g][0]))), F.col("__range")) if asked else F.lit(0)
    near = counted.filter(F.col("__range").isin(asked)).withColumn("upto", upto)

    def between(k: str) -> Column:
        low, high = (F.min(F.when(F.col("upto") > e, F.col("v"))) for e in ends[k])
        at = shares[k] * (n - 1)
        return (low if ends[k][0] == ends[k][1] else (ends[k][1] - at) * low + (at - ends[k][0]) * high).alias(k)

    return near.agg(*map(between, shares))
