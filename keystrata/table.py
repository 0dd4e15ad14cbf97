"""A versioned keyed table: immutable sorted runs behind a manifest.

Writers flush batches of changes as first-level runs; readers pin a manifest version and
never see a half-written state.  At ``trigger`` first-level runs a compaction merges them
with the second-level runs that their key range touches.  Deletes are dropped only when
every older run that overlaps is an input; otherwise they stay and keep hiding old versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bloom import parquet_bloom
from .manifest import Manifest, Run, Version
from .model import CHANGE, DELETE, PUT, validated
from .operators.runs import L0_TRIGGER
from .operators.versions import multi_get, newest
from .sources import wal


class KVTable:
    def __init__(self, spark: SparkSession, root: str, trigger: int = L0_TRIGGER, run_rows: int = 10_000_000):
        self.spark, self.root, self.trigger, self.run_rows = spark, root.rstrip("/"), trigger, run_rows
        self.manifest = Manifest(spark, self.root)

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> KVTable:
        """Opening is recovery: the newest manifest version is the table; unpublished runs are ignored."""
        return cls(spark, root, **options)

    # Writes

    def write(self, changes: DataFrame, batch_id: int | None = None) -> Version:
        """Flush a batch of changes as one run and compact if it is time.

        Batch ids rise, as a stream's do: one up to the greatest applied is skipped, and only that one is kept.
        """
        base = self.manifest.read()
        if batch_id is not None and base.batches and batch_id <= max(base.batches):
            return base
        batches = list(base.batches) if batch_id is None else [batch_id]
        run = self._run(validated(changes), base.next_run, 0)
        version = self.manifest.commit(base, list(base.runs) + ([run] if run else []), batches)
        if sum(r.level == 0 for r in version.runs) >= self.trigger:
            version = self.compact()
        return version

    def put(self, rows: list[tuple[bytes, bytes, int]]) -> Version:
        return self.write(self.spark.createDataFrame([(k, s, PUT, v) for k, v, s in rows], CHANGE))

    def delete(self, rows: list[tuple[bytes, int]]) -> Version:
        return self.write(self.spark.createDataFrame([(k, s, DELETE, None) for k, s in rows], CHANGE))

    def recover(self, logs: DataFrame) -> Version:
        """Flush what the logs hold (rows of the binaryFile source): of each its longest valid prefix.

        Changes carry their writers' sequence numbers, so those that an earlier flush has already change nothing.
        """
        return self.write(wal.replay(logs).select("key", "seq", "op", "value"))

    def _run(self, log: DataFrame, run_id: int, level: int) -> Run | None:
        """Write a run sorted by (key, seq descending), with min/max statistics and a Bloom filter on the key.

        The input is computed once and staged: counts, range sampling and the sorted write read the staged rows.
        """
        path, staged = f"runs/{run_id}-{uuid.uuid4().hex[:8]}", f"{self.root}/staging/{uuid.uuid4().hex}"
        log.select("key", "seq", "op", "value").write.parquet(staged)
        try:
            return self._sorted(self.spark.read.schema(CHANGE).parquet(staged), path, run_id, level)
        finally:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _sorted(self, log: DataFrame, path: str, run_id: int, level: int) -> Run | None:
        n = log.count()
        if n == 0:
            return None
        parts = max(1, -(-n // self.run_rows))
        ordered = log.select("key", "seq", "op", "value").repartitionByRange(parts, "key").sortWithinPartitions("key", F.desc("seq"))
        ordered.write.options(**parquet_bloom("key", -(-n // parts))).parquet(f"{self.root}/{path}")
        s = self.spark.read.schema(CHANGE).parquet(f"{self.root}/{path}").agg(F.hex(F.min("key")), F.hex(F.max("key")), F.count("*"), F.max("seq")).first()
        return Run(run_id, level, path, *s)

    # Reads

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], CHANGE).withColumn("run_id", F.lit(0).cast("long"))
        parts = [self.spark.read.schema(CHANGE).parquet(f"{self.root}/{r.path}").withColumn("run_id", F.lit(r.run_id).cast("long")) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def versions(self, number: int | None = None) -> DataFrame:
        """Every retained version of every key."""
        return self._read(list(self.manifest.read(number).runs))

    def newest(self, number: int | None = None) -> DataFrame:
        """One row for each key, deletes included."""
        return newest(self.versions(number), order=[F.col("seq").desc(), F.col("run_id").desc()])

    def scan(self, number: int | None = None, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Live (key, seq, value) rows of low <= key < high; runs outside the range aren't read."""
        runs = [r for r in self.manifest.read(number).runs if (low is None or r.max_key >= low.hex().upper()) and (high is None or r.min_key < high.hex().upper())]
        log = self._read(runs)
        log = log if low is None else log.where(F.col("key") >= F.lit(bytearray(low)))
        log = log if high is None else log.where(F.col("key") < F.lit(bytearray(high)))
        best = newest(log, order=[F.col("seq").desc(), F.col("run_id").desc()])
        return best.where(F.col("op") != DELETE).select("key", "seq", "value")

    def get(self, key: bytes, number: int | None = None) -> tuple[str, int | None, bytes | None]:
        """(status, seq, value) of one key: runs by range, then row groups by statistics and Bloom filter."""
        h = key.hex().upper()
        runs = [r for r in self.manifest.read(number).runs if r.min_key <= h <= r.max_key]
        row = newest(self._read(runs).where(F.col("key") == F.lit(bytearray(key))), order=[F.col("seq").desc(), F.col("run_id").desc()]).first()
        if row is None:
            return "absent", None, None
        return ("deleted", row["seq"], None) if row["op"] == DELETE else ("hit", row["seq"], bytes(row["value"]))

    def multi_get(self, probes: DataFrame, number: int | None = None) -> DataFrame:
        """Status, seq and value of many keys (column key) at once."""
        return multi_get(probes, self.newest(number))

    # Maintenance

    def compact(self) -> Version:
        """Merge all first-level runs with the second-level runs that they overlap, into one run."""
        base = self.manifest.read()
        l0 = [r for r in base.runs if r.level == 0]
        if not l0:
            return base
        low, high = min(r.min_key for r in l0), max(r.max_key for r in l0)
        touched = [r for r in base.runs if r.level == 1 and not (r.max_key < low or r.min_key > high)]
        inputs = l0 + touched
        rest = [r for r in base.runs if r not in inputs]
        low, high = min(r.min_key for r in inputs), max(r.max_key for r in inputs)
        bottom = not any(r.min_key <= high and r.max_key >= low for r in rest)
        merged = newest(self._read(inputs), order=[F.col("seq").desc(), F.col("run_id").desc()])
        if bottom:
            merged = merged.where(F.col("op") != DELETE)
        run = self._run(merged, base.next_run, 1)
        runs = sorted([r for r in rest] + ([run] if run else []), key=lambda r: (r.level, r.min_key))
        return self.manifest.commit(base, runs, list(base.batches))

    def vacuum(self, keep: set[int] = frozenset()) -> list[str]:
        """Drop runs that neither the newest nor a kept version needs: readers name the versions they have pinned."""
        return self.manifest.expire(set(keep))
