"""Latest state, merges and layered reads of versioned records.

The winner of a key is its greatest seq; ties go to the newest run, then to the order
columns that the caller names.  Deletes take part in the contest and are dropped after it:
dropping them first would bring back keys.  The window form lets Spark keep one row for
each key and task before the shuffle (WindowGroupLimit), so a hot key costs no more there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETE
from .ranges import range_bucket


def newest(log: DataFrame, keys: list[str] | str = "key", order: list[Column] | None = None) -> DataFrame:
    """One row for each key, deletes included; order: the contest, best first (seq descending by default)."""
    keys = [keys] if isinstance(keys, str) else keys
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col("seq").desc()]))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_state(log: DataFrame, keys: list[str] | str = "key", order: list[Column] | None = None) -> DataFrame:
    """The live rows of ``newest``."""
    return newest(log, keys, order).where(F.col("op") != DELETE)


def version_scan(log: DataFrame) -> DataFrame:
    """Every version with its ordinal within the key (1 = newest); sort by (key, version) for the scan's order."""
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return log.withColumn("version", F.row_number().over(w))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live state at a sequence number, while its versions are retained."""
    return latest_state(log.where(F.col("seq") <= seq))


def merge_runs(runs: list[DataFrame], bottom: bool, tie: str | None = "run_id") -> DataFrame:
    """Compaction: one row for each key of all runs; bottom: nothing older exists, so deletes go too."""
    log = runs[0]
    for r in runs[1:]:
        log = log.unionByName(r)
    order = [F.col("seq").desc()] + ([F.col(tie).desc()] if tie else [])
    kept = newest(log, order=order)
    return kept.where(F.col("op") != DELETE) if bottom else kept


def multi_get(probes: DataFrame, state: DataFrame) -> DataFrame:
    """For every probe key: status hit, deleted or absent, and seq and value of its newest version.

    state: one row for each key, deletes included.  Spark broadcasts whichever side is small
    by its size statistics and shuffles both otherwise.
    """
    found = probes.join(state.select("key", "seq", "op", "value"), "key", "left")
    status = F.when(F.col("op").isNull(), "absent").when(F.col("op") == DELETE, "deleted").otherwise("hit")
    return found.select("key", status.alias("status"), "seq", F.when(F.col("op") != DELETE, F.col("value")).alias("value"))


def point_get(log: DataFrame, key) -> DataFrame:
    """One key: the filter reaches the scan, where min/max statistics and Bloom filters skip files."""
    return newest(log.where(F.col("key") == F.lit(key)))


def layered_get(layers: DataFrame) -> DataFrame:
    """First layer that knows a key wins (column layer, 0 = newest), then its greatest seq.

    Equals ``newest`` whenever sequence numbers rise in write order.
    """
    return newest(layers, order=[F.col("layer").asc(), F.col("seq").desc()])


def lower_bound(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """For every probe the smallest key that is not less (null if none).

    Keys and probes are merged in one ordered pass by ranges: each range carries the first
    key of the ranges after it, so no task sees more than its own range.
    """
    both = keys.select("key", F.lit(True).alias("is_key")).distinct().unionByName(probes.select("key", F.lit(False).alias("is_key")).distinct())
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = both.withColumn("part", range_bucket(both, "key", parts))
    firsts = ranged.where("is_key").groupBy("part").agg(F.min("key").alias("first"))  # one row for each range
    ids = both.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    later = ids.alias("i").join(F.broadcast(firsts).alias("e"), F.col("e.part") > F.col("i.part"), "left").groupBy(F.col("i.part").alias("part")).agg(F.min("e.first").alias("after"))
    w = Window.partitionBy("part").orderBy("key").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    own = ranged.withColumn("bound", F.min(F.when(F.col("is_key"), F.col("key"))).over(w))
    return own.where("not is_key").join(F.broadcast(later), "part", "left").select("key", F.coalesce("bound", "after").alias("bound"))


def range_scan(log: DataFrame, low, high) -> DataFrame:
    """Live rows with low <= key < high, in key order."""
    return latest_state(log.where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))).orderBy("key")


def snapshot_retention(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """Versions that live snapshots need: of each key the newest with seq <= s, for every pinned s.

    One pass: a version is the newest for the snapshots between it and the key's next version.
    """
    w = Window.partitionBy("key").orderBy("seq")
    following = log.withColumn("following", F.lead("seq").over(w))
    needed = F.filter(F.array(*(F.lit(int(s)).cast("long") for s in snapshots)), lambda s: (s >= F.col("seq")) & (F.col("following").isNull() | (s < F.col("following"))))
    return following.withColumn("snapshot", F.explode(needed)).drop("following")


def map_replay(ops: DataFrame) -> DataFrame:
    """Keyed-map operations (key, seq, op insert/remove/get, value) with their results: ``prior``, the value before each."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("op") != "get", F.struct(F.col("op"), F.col("value")))
    before = F.last(change, ignorenulls=True).over(w)
    return ops.withColumn("prior", F.when(before["op"] == "insert", before["value"]))
