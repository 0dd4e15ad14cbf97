"""The sorted table file format, for interoperability: blocks, index, filter, 40-byte footer (little-endian).

Entry: key length u32, value length u32 (0xFFFFFFFF: deleted), seq u64, key, value.  A
block closes when it reaches 4096 bytes.  Index entry: key length u32, last key, offset u64, length u64.
Footer: index offset and length, filter offset and length, magic (u64 each).
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterable, Iterator

from ..functions import bloom

MAGIC = 0x53535441424C4531
BLOCK = 4096
DELETED = 0xFFFFFFFF

Entry = tuple[bytes, bytes | None, int]


def encode_entry(key: bytes, value: bytes | None, seq: int) -> bytes:
    return struct.pack("<IIQ", len(key), DELETED if value is None else len(value), seq) + key + (value or b"")


def write(entries: Iterable[Entry]) -> bytes:
    """A whole file from entries in order of (key, seq descending)."""
    out, block, index, keys, last = bytearray(), bytearray(), [], [], None

    def cut() -> None:
        index.append(struct.pack("<I", len(last)) + last + struct.pack("<QQ", len(out), len(block)))
        out.extend(block)
        block.clear()

    for key, value, seq in entries:
        if last is not None and key < last:
            raise ValueError("entries must be sorted by key")
        block += encode_entry(key, value, seq)
        keys.append(key)
        last = key
        if len(block) >= BLOCK:
            cut()
    if block:
        cut()
    index_at, index_bytes = len(out), b"".join(index)
    filter_bytes = bloom.build(keys)
    out += index_bytes + filter_bytes
    return bytes(out + struct.pack("<5Q", index_at, len(index_bytes), index_at + len(index_bytes), len(filter_bytes), MAGIC))


class SortedTable:
    """Reader over a file's bytes."""

    def __init__(self, data: bytes):
        if len(data) < 40:
            raise ValueError("too short for a sorted table")
        at, size, f_at, f_size, magic = struct.unpack("<5Q", data[-40:])
        if magic != MAGIC:
            raise ValueError("not a sorted table")
        if at + size > len(data) or f_at + f_size > len(data):
            raise ValueError("footer points outside the file")
        self.data, self.filter, self.index = data, data[f_at : f_at + f_size], []
        end = at + size
        while at < end:
            (n,) = struct.unpack_from("<I", data, at)
            if at + 20 + n > end:
                raise ValueError("index entry is cut")
            self.index.append((data[at + 4 : at + 4 + n], *struct.unpack_from("<QQ", data, at + 4 + n)))
            at += 20 + n

    def block(self, i: int) -> Iterator[Entry]:
        _, at, size = self.index[i]
        end = at + size
        while at < end:
            if at + 16 > end:
                raise ValueError("block entry is cut")
            k, v, seq = struct.unpack_from("<IIQ", self.data, at)
            n = 0 if v == DELETED else v
            if at + 16 + k + n > end:
                raise ValueError("block entry is cut")
            yield self.data[at + 16 : at + 16 + k], None if v == DELETED else self.data[at + 16 + k : at + 16 + k + n], seq
            at += 16 + k + n

    def __iter__(self) -> Iterator[Entry]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, key: bytes) -> tuple[bytes | None, int] | None:
        """(value or None if deleted, seq) of the newest version, or None if the key isn't there."""
        if not bloom.contains(self.filter, [key])[0]:
            return None
        for i in range(bisect.bisect_left(self.index, key, key=lambda e: e[0]), len(self.index)):
            for k, v, seq in self.block(i):
                if k == key:
                    return v, seq
                if k > key:
                    return None
        return None
