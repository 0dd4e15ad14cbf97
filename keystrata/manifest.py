"""Versioned manifests: which runs a snapshot of a table consists of.

A version is one JSON file, written whole under a temporary name and renamed.  The rename
fails if the version exists, so of two writers one loses and can retry.  On stores without
atomic rename a conditional put is needed instead.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Run:
    run_id: int
    level: int
    path: str
    min_key: str  # hex
    max_key: str
    rows: int
    max_seq: int


@dataclass(frozen=True)
class Version:
    number: int = 0
    runs: tuple[Run, ...] = ()
    batches: tuple[int, ...] = field(default=())  # stream batches already applied

    @property
    def next_run(self) -> int:
        return max((r.run_id for r in self.runs), default=0) + 1


class Files:
    """Small files through Hadoop's file systems, so that any store that Spark reaches will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write under a temporary name, then rename; False if the name is taken."""
        if self.fs.exists(self.path(name)):
            return False
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(temporary))
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.rename(self.path(temporary), self.path(name)):
            return True
        self.fs.delete(self.path(temporary), False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def numbers(self) -> list[int]:
        names = self.files.names("manifest")
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, number: int | None = None) -> Version:
        """A version, the newest by default; version 0 is the empty table."""
        have = self.numbers()
        number = (have[-1] if have else 0) if number is None else number
        if number == 0:
            return Version()
        d = json.loads(self.files.read(f"manifest/v{number}.json"))
        return Version(number, tuple(Run(**r) for r in d["runs"]), tuple(d["batches"]))

    def commit(self, base: Version, runs: list[Run], batches: list[int]) -> Version:
        """Publish the successor of base; fails if another writer was first."""
        if self.numbers()[-1:] not in ([], [base.number]):
            raise RuntimeError(f"version {base.number} isn't the newest any more")
        new = Version(base.number + 1, tuple(runs), tuple(batches))
        text = json.dumps({"runs": [asdict(r) for r in new.runs], "batches": list(new.batches)})
        if not self.files.publish(f"manifest/v{new.number}.json", text):
            raise RuntimeError(f"version {new.number} was published by another writer")
        return new

    def expire(self, keep: set[int]) -> list[str]:
        """Drop versions that aren't kept, then run folders that no kept version names; the newest is always kept."""
        have = self.numbers()
        keep = keep | set(have[-1:])
        live = {r.path for n in have if n in keep for r in self.read(n).runs}
        for n in have:
            if n not in keep:
                self.files.delete(f"manifest/v{n}.json")
        dead = [f"runs/{n}" for n in self.files.names("runs") if f"runs/{n}" not in live]
        for path in dead:
            self.files.delete(path)
        return dead
