"""Deterministic range buckets for global order without a single task."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS_FROM = 1000  # values that the cuts are chosen from: of each of so many hash classes the one with the smallest hash


def range_bucket(values: DataFrame, column: str, parts: int) -> Column:
    """The bucket (from 0) of a value of the column: as many cuts as there are parts, less one.

    Cuts come from a bounded set of values chosen by their hash, so every evaluation of a
    plan puts a row in the same bucket, and a frequent value counts once.  They balance the buckets; any
    cuts give right results.  One pass finds them, with at most ``CUTS_FROM`` rows from a task.  A row's
    bucket is found among the cuts in two steps of about the root of their number.
    """
    known = values.select(column).where(F.col(column).isNotNull())
    h = F.xxhash64(column)
    ordered = sorted(r["v"] for r in known.groupBy(F.pmod(h, F.lit(CUTS_FROM))).agg(F.min_by(column, h).alias("v")).collect())
    cuts = sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)}) if ordered else []
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts) - 1) + 1
    groups = [[F.lit(bytearray(c) if isinstance(c, (bytes, bytearray)) else c) for c in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    upto = lambda a: F.size(F.filter(a, lambda c: c <= F.col(column)))
    group = upto(F.array(*(g[0] for g in groups))) - 1
    return F.when(group < 0, 0).otherwise(group * step + upto(F.get(F.array(*(F.array(*g) for g in groups)), group))).cast("int")


def ranged(df: DataFrame, order: Column) -> DataFrame:
    """df with the order as ``_o`` and its range as ``_p``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_o", order)
    return keyed.withColumn("_p", range_bucket(keyed, "_o", parts))


def totals_before(rows: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """(keys, _p, _before): for every range of a key the amounts in the key's ranges before it; one row for each key and range."""
    sums = rows.groupBy(*keys, "_p").agg(F.sum(amount).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "_p", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
