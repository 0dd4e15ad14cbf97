"""Wire requests: PUT is [1][key u64][value u64], GET is [2][key u64], big-endian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT_BYTES, GET_BYTES = 17, 9


def be64(value: Column) -> Column:
    """A non-negative integer as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def u64(data: Column) -> Column:
    """Eight big-endian bytes as a number; decimal, as half of the range doesn't fit a long."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def encode_put(key: Column, value: Column) -> Column:
    return F.concat(F.unhex(F.lit("01")), be64(key), be64(value))


def encode_get(key: Column) -> Column:
    return F.concat(F.unhex(F.lit("02")), be64(key))


def split_frames(buffers: DataFrame, raw: str = "raw") -> DataFrame:
    """All frames of each receive buffer, in order: column frame (binary) and pos (from 0).

    A buffer may hold any number of requests.  What follows the last whole request is one
    frame, which ``decode`` marks as echo.
    """
    h = F.hex(raw)
    found = F.regexp_extract_all(h, F.lit(r"\G(01[0-9A-F]{32}|02[0-9A-F]{16}|[0-9A-F]+$)"), F.lit(1))
    return buffers.select(*[c for c in buffers.columns if c != raw], F.posexplode(found).alias("pos", "_f")).withColumn("frame", F.unhex("_f")).drop("_f")


def decode(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """cmd, key, val and status (put, get or echo) of each frame; extra bytes after a request make it an echo."""
    f, n = F.col(frame), F.octet_length(frame)
    first = F.hex(F.substring(f, 1, 1))
    status = F.when((first == "01") & (n == PUT_BYTES), "put").when((first == "02") & (n == GET_BYTES), "get").otherwise("echo")
    key = F.when(status != "echo", u64(F.substring(f, 2, 8)))
    val = F.when(status == "put", u64(F.substring(f, 10, 8)))
    return frames.withColumn("status", status).withColumn("key", key).withColumn("val", val)


def replies(gets: DataFrame) -> DataFrame:
    """What a GET answers: the value, if the lookup (status, value) is a live one of eight bytes."""
    return gets.where((F.col("status") == "hit") & (F.octet_length("value") == 8))


def tag(fd: Column, op: Column) -> Column:
    """A completion's tag: the descriptor in the low 32 bits, the operation in the next eight."""
    return F.shiftleft(op.cast("long"), 32).bitwiseOR(fd.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def tag_fd(tagged: Column) -> Column:
    low = tagged.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def tag_op(tagged: Column) -> Column:
    return F.shiftright(tagged, 32).bitwiseAND(F.lit(0xFF)).cast("int")
