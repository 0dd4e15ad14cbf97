"""Sorted runs: key ranges, choice of runs to compact or to read, sizes and block layouts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .ranges import ranged, totals_before

ENTRY_HEADER = 16  # key length, value length, seq
MEMTABLE_ENTRY = 24
BLOCK = 4096
L0_TRIGGER = 4


def run_minmax(log: DataFrame) -> DataFrame:
    """Key range, rows and greatest seq of every run (column run_id)."""
    return log.groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("rows"), F.max("seq").alias("max_seq"))


def overlap_select(l0: DataFrame, l1: DataFrame) -> DataFrame:
    """Second-level runs that the envelope of all first-level runs touches; l0 and l1 are rows of ``run_minmax``."""
    envelope = l0.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))  # one row
    return l1.join(F.broadcast(envelope), (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))).select(l1.columns)


def l0_groups(runs: DataFrame, trigger: int = L0_TRIGGER) -> DataFrame:
    """The compaction that each first-level run goes into, in order of run_id from 1."""
    return runs.withColumn("compaction", F.floor((F.col("run_id") - 1) / trigger).cast("long"))


def run_pruning(probes: DataFrame, runs: DataFrame) -> DataFrame:
    """How many runs' ranges hold each probe key, which is one row however often it is asked for.

    One ordered pass over keys and ends of runs, by ranges: a run counts from its least key to its greatest.
    No probe meets a run, so the work is the sum of both, not their product.
    """
    known = runs.where("min_key is not null and max_key is not null")
    points = probes.select("key", F.lit(1).alias("kind"), F.lit(0).alias("step")).distinct()
    points = points.unionByName(known.select(F.col("min_key").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step")))
    points = points.unionByName(known.select(F.col("max_key").alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step")))
    rows = ranged(points, F.col("key"))
    w = Window.partitionBy("_p").orderBy("_o", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("_open", F.sum("step").over(w)).where("kind = 1")
    before = totals_before(rows, [], F.col("step"))  # one row for each range
    return swept.join(F.broadcast(before), "_p").select("key", (F.col("_open") + F.col("_before")).alias("runs_touched"))


def resetting_groups(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Number the blocks of each group when a block closes as soon as its size reaches the limit.

    A block overshoots, so the running sum restarts at each cut: a sequential fold, in one
    task for each group.  Groups are runs or logs, whose size the flush limit bounds.
    """
    ship(rows.sparkSession)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        block, used, out = 0, 0, []
        for s in pdf[size].tolist():
            out.append(block)
            used += s
            if used >= limit:
                block, used = block + 1, 0
        return pdf.assign(block_id=pd.Series(out, index=pdf.index, dtype="int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", block_id long"
    return rows.groupBy(group).applyInPandas(fold, schema)


def block_layout(entries: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(run_id, block_id, last_key, bytes, entries) of the blocks of sorted runs; entries: run_id, pos, key, size."""
    blocks = resetting_groups(entries, "run_id", "pos", "size", limit)
    return blocks.groupBy("run_id", "block_id").agg(F.max("key").alias("last_key"), F.sum("size").alias("bytes"), F.count("*").alias("entries"))


def write_amplification(entries: DataFrame) -> DataFrame:
    """Physical over logical bytes of each run; entries: run_id, key_bytes, value_bytes."""
    logical = F.sum(F.col("key_bytes") + F.col("value_bytes"))
    physical = F.sum(F.col("key_bytes") + F.col("value_bytes") + ENTRY_HEADER)
    return entries.groupBy("run_id").agg(physical.cast("long").alias("physical"), logical.cast("long").alias("logical"), F.round(physical / logical, 6).alias("amplification"))
