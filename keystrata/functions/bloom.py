"""A split-block Bloom filter in numpy: 32-byte blocks of eight words, ten bits for each key.

For tables the idiomatic filter is Parquet's own (``PARQUET_BLOOM``); this one has the public
split-block layout with the key-value store's hash, for filters that travel outside Parquet.
"""

from __future__ import annotations

import numpy as np

BITS_PER_KEY = 10

# The hash's seed and multiplier, and the eight salts of the split-block layout.
SEED = 0xC6A4A7935BD1E995
MULTIPLIER = 0x5BD1E9955BD1E995
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)


def hash64(keys: list[bytes]) -> np.ndarray:
    """For each 8-byte little-endian chunk (the last padded with zeros): xor, multiply, xor with itself shifted by 47."""
    size = np.array([len(k) for k in keys], dtype=np.int64)
    chunks = -(-size // 8)
    width = int(chunks.max()) if len(keys) else 0
    data = np.frombuffer(b"".join(k.ljust(8 * width, b"\0") for k in keys), "<u8").reshape(len(keys), width) if width else np.zeros((len(keys), 0), np.uint64)
    h = np.full(len(keys), SEED, np.uint64)
    for i in range(width):
        x = (h ^ data[:, i]) * np.uint64(MULTIPLIER)
        h = np.where(chunks > i, x ^ (x >> np.uint64(47)), h)
    return h


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), (low[:, None] * SALTS) >> np.uint32(27)


def build(keys: list[bytes]) -> bytes:
    blocks = max(1, -(-BITS_PER_KEY * len(keys) // 256))
    words = np.zeros((blocks, 8), np.uint32)
    block, bit = _places(hash64(keys), blocks)
    for i in range(8):
        np.bitwise_or.at(words[:, i], block, np.uint32(1) << bit[:, i])
    return words.tobytes()


def contains(data: bytes, keys: list[bytes]) -> np.ndarray:
    """Whether each key may be present; a filter of no or of odd length is not a filter."""
    if not data or len(data) % 32:
        raise ValueError("a filter is a positive number of 32-byte blocks")
    words = np.frombuffer(data, np.uint32).reshape(-1, 8)
    block, bit = _places(hash64(keys), len(words))
    return ((words[block] >> bit) & 1).all(axis=1)


def parquet_bloom(column: str, distinct: int, fpp: float = 0.01) -> dict[str, str]:
    """Writer options for Parquet's own filter on a column."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(max(1, distinct)), f"parquet.bloom.filter.fpp#{column}": str(fpp)}
