"""Ordering and routing: FIFO batches, sequence assignment, shards and their replicas."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .ranges import ranged, totals_before

DRAIN = 16


def positions(df: DataFrame, order: Column) -> DataFrame:
    """Global positions from 1 in an order, without gathering the rows in one task.

    Rows are dealt into ranges; each range numbers its own and adds the rows before it.
    """
    rows = ranged(df, order)
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy("_o")))
    placed = numbered.join(F.broadcast(totals_before(rows, [], F.lit(1))), "_p")  # one row for each range
    return placed.select(*df.columns, (F.col("_rn") + F.col("_before")).alias("position"))


def fifo_batches(items: DataFrame, offset: Column, batch: int = DRAIN) -> DataFrame:
    """Items in offset order, dealt into drain batches of a fixed size."""
    p = positions(items, offset)
    return p.withColumn("batch_id", F.floor((F.col("position") - 1) / batch).cast("long"))


def _by_range(rows: DataFrame, ranges: DataFrame, shard: str) -> DataFrame:
    """rows with the columns of their shard's range; a null shard is one of its own."""
    r = ranges.withColumnsRenamed({shard: "_shard", "_p": "_range"})
    return rows.join(r, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_p") == F.col("_range")))


def assign_seq(df: DataFrame, shard: str, order: Column) -> DataFrame:
    """Sequence numbers from 1 within each shard, in arrival order.

    A shard's ranges number their own rows and add the shard's rows before them, so a shard is as many tasks as there are ranges.
    """
    rows = ranged(df, order)
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(shard, "_p").orderBy("_o")))
    placed = _by_range(numbered, totals_before(rows, [shard], F.lit(1)), shard)
    return placed.select(*df.columns, (F.col("_rn") + F.col("_before")).alias("seq"))


def route(df: DataFrame, key: Column, shards: int) -> DataFrame:
    """The shard that owns each row."""
    return df.withColumn("core", F.pmod(key, F.lit(shards)).cast("long"))


def replicate(routed: DataFrame, shards: int) -> DataFrame:
    """Every row at its owner and, one hop on, at the next shard (copies aren't forwarded)."""
    copies = F.array(F.struct(F.col("core").alias("target"), F.lit(False).alias("replica")), F.struct(F.pmod(F.col("core") + 1, F.lit(shards)).alias("target"), F.lit(True).alias("replica")))
    return routed.withColumn("_c", F.explode(copies)).select("*", "_c.target", "_c.replica").drop("_c")


def regressions(df: DataFrame, shard: str, order: Column, seq: str = "seq") -> DataFrame:
    """Rows whose sequence number isn't greater than the one before in their shard.

    Each range of a shard compares its own rows; its first one is held against the last of the shard's range before.
    """
    rows = ranged(df, order)
    ends = rows.groupBy(shard, "_p").agg(F.max(F.struct("_o", F.col(seq).alias("_s")))["_s"].alias("_last"))
    ends = ends.select(shard, "_p", F.lag("_last").over(Window.partitionBy(shard).orderBy("_p")).alias("_edge"))
    w = Window.partitionBy(shard, "_p").orderBy("_o")
    own = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_before", F.lag(seq).over(w))
    previous = F.when(F.col("_rn") == 1, F.col("_edge")).otherwise(F.col("_before"))
    return _by_range(own, ends, shard).select(*df.columns, previous.alias("previous")).where(F.col(seq) <= F.col("previous"))


def queue_replay(ops: DataFrame, capacity: int) -> DataFrame:
    """Outcomes of pushes and pops on bounded FIFO queues (queue, seq, op push/pop, item): result ok, full or empty, and out.

    A queue's operations depend on each other one by one, so each queue is one task; a full
    push is refused, as by a bounded queue, and keeps its item.
    """
    ship(ops.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, rows = deque(), []
        pdf = pdf.sort_values("seq", kind="stable")
        for op, item in zip(pdf["op"], pdf["item"]):
            if op == "push":
                rows.append(("full" if len(held) >= capacity else "ok", None))
                if len(held) < capacity:
                    held.append(item)
            else:
                rows.append(("ok", held.popleft()) if held else ("empty", None))
        return pd.DataFrame({"queue": pdf["queue"].to_numpy(), "seq": pdf["seq"].to_numpy(), "op": pdf["op"].to_numpy(), "result": [r for r, _ in rows], "out": pd.array([o for _, o in rows], dtype="Int64")})

    return ops.groupBy("queue").applyInPandas(run, "queue long, seq long, op string, result string, out long")
