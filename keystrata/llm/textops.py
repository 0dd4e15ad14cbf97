"""Vectorised text primitives over Arrow batches: words, word hashes, shingle sets.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D after A-Z are
lower-cased; that is exact on UTF-8, where those bytes never occur inside a longer
character.  All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The public SplitMix64 finaliser on an unsigned array."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = mix(LOWER.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
_BASE = _U(0x9E3779B97F4A7C55)
_STEP = [int(mix(np.array([k], dtype=np.uint64))[0]) | 1 for k in range(1, 65)]
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the process up to the chunk size."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK:
            _powers[name] = have
    return have


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets into them; nulls count as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, size: int) -> list[int]:
    """Chunk borders at document starts or at white space, about size bytes apart."""
    cuts, at, end = [0], 0, len(data)
    while end - at > size:
        k = int(np.searchsorted(offsets, at + size, "right")) - 1
        to = int(offsets[k])
        if to <= at:  # inside one long text
            window = np.flatnonzero(SPACE[data[at + size // 2 : at + size]])
            if len(window):
                to = at + size // 2 + int(window[-1])
            else:  # a word longer than a chunk: up to its end
                to, stop = at + size, int(offsets[k + 1])
                while to < stop:
                    more = np.flatnonzero(SPACE[data[to : min(stop, to + size)]])
                    if len(more):
                        to += int(more[0])
                        break
                    to = min(stop, to + size)
        cuts.append(to)
        at = to
    cuts.append(end)
    return cuts


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def located_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, n + 1 offsets of the documents into them, and each word's first byte."""
    parts, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    cuts = _cuts(data, offsets, CHUNK)
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        part = data[a:b]
        inside = offsets[(offsets > a) & (offsets < b)] - a
        s, e = word_spans(part, inside)
        if not len(s):
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * _power("up", int(_BASE), len(part))[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * _power("down", _INVERSE, len(part))[s]
        parts.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + a)
    first = np.concatenate(starts)
    return np.concatenate(parts), np.searchsorted(first, offsets).astype(np.int64), first


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and n + 1 offsets of the documents into them."""
    return located_words(data, offsets)[:2]


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in order, with offsets: of fewer words, the whole sequence; of none, nothing."""
    counts = np.diff(at)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(to[-1], np.uint64)
    if len(words) >= n:
        rolled = words[: len(words) - n + 1] * _U(_STEP[0])
        for k in range(1, n):
            rolled += words[k : len(words) - n + 1 + k] * _U(_STEP[k])
        owner = np.repeat(np.arange(len(counts)), counts)
        whole = owner[: len(words) - n + 1] == owner[n - 1 :]
        target = np.repeat(counts >= n, sizes)
        out[target] = mix(rolled[whole] + _U(n))
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        w = words[at[d] : at[d + 1]]
        value = sum(int(x) * _STEP[k] for k, x in enumerate(w)) + len(w)
        out[to[d]] = mix(np.array([value & (2**64 - 1)], dtype=np.uint64))[0]
    return out, to


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """For every text the sorted distinct shingle hashes."""
    data, offsets = buffers(texts)
    words, at = word_hashes(data, offsets)
    flat, to = shingle_hashes(words, at, n)
    sets = []
    for a, b in zip(to[:-1], to[1:]):
        s = np.sort(flat[a:b])
        sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s)
    return sets


def tidy() -> None:
    """Give freed memory back: worker processes live on between tasks, and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20):
    """Consecutive parts of a batch with about size bytes of the column in each, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, offsets = buffers(texts)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    tidy()
