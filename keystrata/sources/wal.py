"""The log's frame format: crc32 u32, length u32, seq u64, payload, little-endian; sectors padded with zeros.

The CRC covers length, seq and payload.  Sixteen zero bytes where a header should be end
the log of a sector-aligned writer; a reader takes the longest valid prefix.  Payloads
hold one change: flag (1 put, 0 delete), key length u32, caller's seq u64, key, value.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

HEADER, SECTOR = 16, 4096
MAX_PAYLOAD = (1 << 20) - SECTOR  # that a writer takes
MAX_DECODED = 16 << 20  # that a reader takes
FRAMES = "pos long, crc long, len long, wal_seq long, payload binary, status string"


def le(value: Column, size: int) -> Column:
    """A non-negative integer as little-endian bytes."""
    h = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * i - 1, 2) for i in range(size, 0, -1))))


def encode(payload: Column, seq: Column) -> Column:
    """One frame, as a Spark expression."""
    body = F.concat(le(F.octet_length(payload), 4), le(seq, 8), payload)
    fits = F.when(F.octet_length(payload) > MAX_PAYLOAD, F.raise_error(F.lit("payload too large")).cast("binary")).otherwise(payload)
    body = F.concat(le(F.octet_length(fits), 4), le(seq, 8), fits)
    return F.concat(le(F.crc32(body), 4), body)


def change_payload(key: Column, seq: Column, op: Column, value: Column) -> Column:
    """A change, with the caller's sequence number, so replay restores the order across logs."""
    return F.concat(F.when(op == "put", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), le(F.octet_length(key), 4), le(seq, 8), key, F.coalesce(value, F.unhex(F.lit(""))))


def decode_change(payload: bytes) -> tuple[bytes, int, str, bytes | None]:
    flag, n, seq = struct.unpack_from("<BIQ", payload)
    key = payload[13 : 13 + n]
    return key, seq, "put" if flag else "delete", payload[13 + n :] if flag else None


def scan(data: bytes) -> Iterator[tuple]:
    """Frames from the start of a log; the last row's status says why it ends: eof, end_of_log, truncated, bad_length, bad_crc or regression."""
    pos, previous = 0, 0
    while True:
        if pos >= len(data):
            yield pos, None, None, None, None, "eof"
            return
        if len(data) - pos < HEADER:
            yield pos, None, None, None, None, "truncated"
            return
        crc, size, seq = struct.unpack_from("<IIQ", data, pos)
        if crc == size == seq == 0:
            yield pos, None, None, None, None, "end_of_log"
            return
        bad = "bad_length" if size > MAX_DECODED else "truncated" if len(data) - pos - HEADER < size else None
        if not bad:
            body = data[pos + 4 : pos + HEADER + size]
            bad = "bad_crc" if zlib.crc32(body) != crc else "regression" if seq <= previous else None
        if bad:
            yield pos, crc, size, None, None, bad
            return
        yield pos, crc, size, seq, bytes(body[12:]), "ok"
        pos, previous = pos + HEADER + size, seq


def append(log: bytes, payloads: list[bytes]) -> tuple[bytes, list[int]]:
    """Reopen a log and append: the whole new log, and the sequence numbers that the payloads got.

    Numbers go on from the last valid frame; what follows it (padding, or a torn frame) is overwritten.
    """
    rows = list(scan(log))
    end, last = rows[-1][0], max((r[3] for r in rows if r[5] == "ok"), default=0)
    frames = []
    for seq, payload in enumerate(payloads, last + 1):
        if len(payload) > MAX_PAYLOAD:
            raise ValueError("payload too large")
        body = struct.pack("<IQ", len(payload), seq) + payload
        frames.append(struct.pack("<I", zlib.crc32(body)) + body)
    return padded([log[:end], *frames]), list(range(last + 1, last + 1 + len(payloads)))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path if "://" in partition.path else "file://" + partition.path)
        with store.open_input_file(path) as f:
            yield from scan(f.read())


class WalFrames(DataSource):
    """``spark.read.format("wal_frames").option("paths", "a,b").load()``: one task for each log."""

    @classmethod
    def name(cls) -> str:
        return "wal_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WalFrames)


def replay(logs: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """Changes of the valid prefix of every log: path, wal_seq, key, seq, op, value; logs: rows of the binaryFile source."""
    ship(logs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, seq, *decode_change(body)) for p, data in zip(f[name], f[content]) for _, _, _, seq, body, status in scan(data) if status == "ok"]
            yield pd.DataFrame(rows, columns=["path", "wal_seq", "key", "seq", "op", "value"])

    return logs.select(name, content).mapInPandas(run, "path string, wal_seq long, key binary, seq long, op string, value binary")


def padded(frames: list[bytes]) -> bytes:
    """A whole log: frames in a row, zeros up to the next sector."""
    data = b"".join(frames)
    return data + bytes(-len(data) % SECTOR)
