import random

import numpy as np
import pytest

from keystrata.functions import bloom
from keystrata.sources import sst, wal


def frames(n, text="record-{}"):
    import struct
    import zlib

    out = []
    for i in range(n):
        body = struct.pack("<IQ", len(text.format(i)), i + 1) + text.format(i).encode()
        out.append(struct.pack("<I", zlib.crc32(body)) + body)
    return out


def test_log_round_trip():
    rows = list(wal.scan(wal.padded(frames(1000))))
    assert [r[3] for r in rows[:-1]] == list(range(1, 1001)) and rows[-1][5] == "end_of_log"
    assert rows[999][4] == b"record-999"


def test_flipped_bit_ends_the_prefix():
    data = bytearray(wal.padded(frames(50, "rec-{}")))
    data[80] ^= 1
    rows = list(wal.scan(bytes(data)))
    assert 0 < sum(r[5] == "ok" for r in rows) < 50 and rows[-1][5] == "bad_crc"


def test_regression_and_sector_boundary():
    a = frames(10)
    rows = list(wal.scan(b"".join([a[9], a[4]])))
    assert [r[5] for r in rows] == ["ok", "regression"]
    many = frames(4097, "x" * 21)
    assert all(len(f) == 37 for f in many)
    assert sum(r[5] == "ok" for r in wal.scan(wal.padded(many))) == 4097


def test_flipped_lengths_end_the_prefix(spark, tmp_path):
    """A damaged length is any u32; the reader keeps the prefix, also through the data source."""
    data = b"".join(frames(50, "rec-{}"))
    for bit in range(32):
        d = bytearray(data)
        d[21 * 3 + 4 + bit // 8] ^= 1 << bit % 8
        rows = list(wal.scan(bytes(d)))
        assert [r[3] for r in rows[:-1]] == [1, 2, 3] and rows[-1][5] in ("bad_length", "bad_crc", "truncated")
    d[21 * 3 + 4 : 21 * 3 + 8] = b"\xff" * 4
    (tmp_path / "log").write_bytes(bytes(d))
    wal.register(spark)
    got = spark.read.format("wal_frames").option("path", str(tmp_path / "log")).load().orderBy("pos").collect()
    assert [r["status"] for r in got] == ["ok"] * 3 + ["bad_length"] and got[-1]["len"] == 2**32 - 1
    large = next(wal.scan(frames(1, "x" * (2 << 20))[0]))
    assert large[5] == "ok" and len(large[4]) == 2 << 20


def test_append_goes_on_after_reopening():
    log, seqs = wal.append(b"", [b"a", b"b"])
    assert seqs == [1, 2] and len(log) == wal.SECTOR
    log, seqs = wal.append(log, [b"c"])
    assert seqs == [3] and [r[4] for r in wal.scan(log) if r[5] == "ok"] == [b"a", b"b", b"c"]
    torn = log.rstrip(b"\0")[:-1]
    log, seqs = wal.append(torn, [b"d"])
    assert seqs == [3] and [r[4] for r in wal.scan(log) if r[5] == "ok"] == [b"a", b"b", b"d"]
    assert wal.append(log, [])[1] == []
    with pytest.raises(ValueError):
        wal.append(b"", [b"x" * (1 << 20)])


def test_any_damage_leaves_a_prefix():
    rnd = random.Random(5)
    good = [r[4] for r in wal.scan(b"".join(frames(60))) if r[5] == "ok"]
    data = b"".join(frames(60))
    for _ in range(200):
        d = bytearray(data)
        if rnd.random() < 0.5:
            d = d[: rnd.randrange(len(d))]
        else:
            d[rnd.randrange(len(d))] ^= 1 << rnd.randrange(8)
        got = [r[4] for r in wal.scan(bytes(d)) if r[5] == "ok"]
        assert got == good[: len(got)]


def test_bloom_filter():
    keys = [f"existing-{i:08}".encode() for i in range(10_000)]
    data = bloom.build(keys)
    assert len(data) == 32 * -(-10 * len(keys) // 256)
    assert bloom.contains(data, keys).all()
    missing = [f"missing-{i:08}".encode() for i in range(100_000)]
    assert bloom.contains(data, missing).mean() < 0.02
    assert bloom.hash64([b"a"])[0] == bloom.hash64([b"a\0"])[0] != bloom.hash64([b"b"])[0]
    with pytest.raises(ValueError):
        bloom.contains(b"", [b"a"])


def test_bloom_hash_by_the_scalar_rule():
    def scalar(k):
        h = bloom.SEED
        for i in range(0, len(k), 8):
            h = ((h ^ int.from_bytes(k[i : i + 8], "little")) * bloom.MULTIPLIER) % 2**64
            h ^= h >> 47
        return h

    keys = [b"", b"a", b"12345678", b"123456789", bytes(40), b"x" * 33]
    assert bloom.hash64(keys).tolist() == [scalar(k) for k in keys]


def test_sorted_table():
    entries = [(f"key-{i:06}".encode(), f"val-{i:06}".encode(), i) for i in range(5000)]
    t = sst.SortedTable(sst.write(entries))
    assert list(t) == entries
    assert t.get(b"key-000123") == (b"val-000123", 123) and t.get(b"non_existing_key") is None
    t = sst.SortedTable(sst.write([(b"k1", b"v1", 1), (b"k2", None, 2), (b"k3", b"", 3)]))
    assert t.get(b"k2") == (None, 2) and t.get(b"k3") == (b"", 3)
    for bad in (b"", b"x" * 39, b"x" * 40):
        with pytest.raises(ValueError):
            sst.SortedTable(bad)


def test_versions_of_a_key_across_blocks():
    entries = [(b"k", b"v" * 1000, 100 - i) for i in range(20)] + [(b"l", b"1", 1)]
    t = sst.SortedTable(sst.write(entries))
    assert len(t.index) > 1 and t.get(b"k")[1] == 100 and t.get(b"l") == (b"1", 1)
    assert np.frombuffer(t.filter, np.uint8).any()
