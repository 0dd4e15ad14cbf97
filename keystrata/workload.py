"""Synthetic workloads: ordered puts, overlapping runs, and wire buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.wire import encode_put


def puts(spark: SparkSession, n: int, prefix: str = "k_", start: int = 0) -> DataFrame:
    """n ordered puts of 10-byte keys and values."""
    i = F.col("id") + start
    digits = F.lpad(i.cast("string"), 8, "0")
    return spark.range(n).select(F.concat(F.lit(prefix), digits).cast("binary").alias("key"), i.alias("seq"), F.lit("put").alias("op"), F.concat(F.lit("v_"), digits).cast("binary").alias("value"))


def levelled(spark: SparkSession, table, runs: int = 40, rows: int = 10_000) -> None:
    """Ordered, disjoint runs flushed one after another into a keyed table, which compacts as it fills."""
    for i in range(runs):
        table.write(puts(spark, rows, start=i * rows), batch_id=i)


def wire_buffers(spark: SparkSession, clients: int = 4, batch: int = 16) -> DataFrame:
    """One receive buffer for each client: batch PUTs of key and twice the key."""
    key = F.floor(F.col("id") / batch).cast("long") * 10_000_000 + F.col("id") % batch
    frames = spark.range(clients * batch).select(F.floor(F.col("id") / batch).cast("int").alias("conn_id"), F.struct(F.col("id"), F.hex(encode_put(key, key * 2)).alias("h")).alias("f"))
    return frames.groupBy("conn_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["h"]), "")).alias("raw"))
