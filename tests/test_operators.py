import random

from pyspark.sql import functions as F

from keystrata.model import CHANGE
from keystrata.operators import queues, runs, versions
from keystrata.sources import wal, wire


def log(spark, rows):
    return spark.createDataFrame([(k.encode(), s, "delete" if v is None else "put", None if v is None else v.encode()) for k, v, s in rows], CHANGE)


def as_dict(df):
    return {bytes(r["key"]).decode(): (None if r["value"] is None else bytes(r["value"]).decode(), r["seq"]) for r in df.collect()}


def test_newest_wins_in_any_order(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(20)}", None if rnd.random() < 0.3 else f"v{i}", i) for i in range(300)]
    want = {}
    for k, v, s in rows:
        want[k] = (v, s)
    live = {k: x for k, x in want.items() if x[0] is not None}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = log(spark, rows).repartition(3)
        assert as_dict(versions.latest_state(df)) == live
        parts = [log(spark, rows[i::3]).withColumn("run_id", F.lit(i)) for i in range(3)]
        assert as_dict(versions.merge_runs(parts, bottom=True)) == live
        assert as_dict(versions.merge_runs(parts, bottom=False)) == want


def test_late_put_loses_to_a_delete(spark):
    df = log(spark, [("k", "a", 5), ("k", None, 7), ("k", "b", 6)])
    assert versions.latest_state(df).count() == 0
    assert as_dict(versions.as_of(df, 6)) == {"k": ("b", 6)}


def test_three_states(spark):
    state = versions.newest(log(spark, [("a", "1", 1), ("b", None, 2), ("c", "", 3)]))
    probes = spark.createDataFrame([(k.encode(),) for k in "abcd"], "key binary")
    got = {bytes(r["key"]).decode(): (r["status"], r["value"] if r["value"] is None else bytes(r["value"])) for r in versions.multi_get(probes, state).collect()}
    assert got == {"a": ("hit", b"1"), "b": ("deleted", None), "c": ("hit", b""), "d": ("absent", None)}


def test_binary_keys_are_unsigned(spark):
    keys = [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    df = spark.createDataFrame([(k,) for k in keys], "key binary")
    got = {bytes(r["key"]): r["bound"] for r in versions.lower_bound(spark.createDataFrame([(b"\x7e",), (b"\x7f\x01",), (b"\xff\x00",)], "key binary"), df).collect()}
    assert bytes(got[b"\x7e"]) == b"\x7f" and bytes(got[b"\x7f\x01"]) == b"\x80" and got[b"\xff\x00"] is None


def test_resetting_blocks_overshoot(spark):
    df = spark.createDataFrame([(1, i, 1500) for i in range(9)], "run_id long, pos long, size long")
    got = [r["block_id"] for r in runs.resetting_groups(df, "run_id", "pos", "size", 4096).orderBy("pos").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_fifo_and_sequences(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("offset"))
    got = sorted((r["offset"], r["position"], r["batch_id"]) for r in queues.fifo_batches(df, F.col("offset")).collect())
    assert got == [(i, i + 1, i // 16) for i in range(500)]


def test_map_replay(spark):
    ops = spark.createDataFrame([("A", 1, "insert", 100), ("B", 2, "insert", 200), ("C", 3, "get", None), ("A", 4, "remove", None), ("A", 5, "get", None), ("B", 6, "remove", None), ("B", 7, "remove", None)], "key string, seq long, op string, value long")
    got = {r["seq"]: r["prior"] for r in versions.map_replay(ops).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 100, 5: None, 6: 200, 7: None}


def test_bounded_queues(spark):
    ops = [(1, 1, "pop", None), (1, 2, "push", 10), (1, 3, "push", 20), (1, 4, "push", 30), (1, 5, "pop", None), (1, 6, "push", 40), (1, 7, "pop", None), (1, 8, "pop", None), (2, 1, "push", 7)]
    df = spark.createDataFrame(ops, "queue long, seq long, op string, item long").repartition(3)
    got = [(r["result"], r["out"]) for r in queues.queue_replay(df, 2).orderBy("queue", "seq").collect()]
    assert got == [("empty", None), ("ok", None), ("ok", None), ("full", None), ("ok", 10), ("ok", None), ("ok", 20), ("ok", 40), ("ok", None)]


def test_wire_frames(spark):
    put, get = b"\x01" + (2**64 - 1).to_bytes(8, "big") + bytes(8), b"\x02" + (7).to_bytes(8, "big")
    buffers = {0: b"", 1: b"\x01" + bytes(7), 2: get, 3: put[:16], 4: put, 5: put + put, 6: get + put + b"PING", 7: b"PING" * 8}
    df = spark.createDataFrame(list(buffers.items()), "id long, raw binary")
    got = {}
    for r in wire.decode(wire.split_frames(df)).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["status"], None if r["key"] is None else int(r["key"])))
    big = 2**64 - 1
    assert got == {1: [("echo", None)], 2: [("get", 7)], 3: [("echo", None)], 4: [("put", big)], 5: [("put", big)] * 2, 6: [("get", 7), ("put", big), ("echo", None)], 7: [("echo", None)]}


def test_wal_source(spark, tmp_path):
    df = log(spark, [("a", "1", 10), ("b", None, 11)]).withColumn("frame", wal.encode(wal.change_payload(F.col("key"), F.col("seq"), F.col("op"), F.col("value")), F.col("seq")))
    data = wal.padded([bytes(r["frame"]) for r in df.orderBy("seq").collect()])
    (tmp_path / "x.wal").write_bytes(data)
    wal.register(spark)
    rows = spark.read.format("wal_frames").option("paths", str(tmp_path / "x.wal")).load().orderBy("pos").collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "end_of_log"]
    assert wal.decode_change(bytes(rows[1]["payload"])) == (b"b", 11, "delete", None)
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.wal"))
    assert [(bytes(r["key"]), r["seq"], r["op"]) for r in wal.replay(files).orderBy("seq").collect()] == [(b"a", 10, "put"), (b"b", 11, "delete")]


def test_plans_push_filters_to_the_scan(spark, tmp_path):
    log(spark, [(f"k{i}", "v", i) for i in range(100)]).write.parquet(str(tmp_path / "t"))
    df = versions.point_get(spark.read.parquet(str(tmp_path / "t")), bytearray(b"k5"))
    assert "PushedFilters: [IsNotNull(key), EqualTo(key" in df._jdf.queryExecution().toString()
    plan = versions.latest_state(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1


def test_sequences_and_regressions_over_ranges(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 1, 2, 2, 2, None]), i * 3, rnd.randrange(50) if rnd.random() < 0.9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "shard int, at long, n long").repartition(5)
    numbers, last, want_seq, want = {}, {}, {}, set()
    for shard, at, n in rows:
        numbers[shard] = numbers.get(shard, 0) + 1
        want_seq[at] = numbers[shard]
        if n is not None and last.get(shard) is not None and n <= last[shard]:
            want.add((at, last[shard]))
        last[shard] = n
    assert {r["at"]: r["seq"] for r in queues.assign_seq(df, "shard", F.col("at")).collect()} == want_seq
    assert {(r["at"], r["previous"]) for r in queues.regressions(df, "shard", F.col("at"), "n").collect()} == want
    assert queues.assign_seq(df.limit(0), "shard", F.col("at")).count() == 0


def test_run_pruning_against_all_pairs(spark):
    rnd = random.Random(6)
    key = lambda: bytes(rnd.randrange(256) for _ in range(rnd.randrange(3)))
    spans = [(i, *sorted((key(), key()))) for i in range(60)] + [(60, None, None)]
    asked = [key() for _ in range(200)] + [None, b"\x80", b"\x80"]
    r = spark.createDataFrame(spans, "run_id int, min_key binary, max_key binary")
    got = {(None if x["key"] is None else bytes(x["key"])): x["runs_touched"] for x in runs.run_pruning(spark.createDataFrame([(k,) for k in asked], "key binary"), r).collect()}
    assert got == {k: 0 if k is None else sum(a is not None and a <= k <= b for _, a, b in spans) for k in asked}


def test_tags(spark):
    df = spark.createDataFrame([(-1, 255), (7, 13), (2**31 - 1, 0), (-(2**31), 1)], "fd int, op int").withColumn("t", wire.tag(F.col("fd"), F.col("op")))
    assert [(r["fd"], r["op"]) == (r["a"], r["b"]) for r in df.select("fd", "op", wire.tag_fd(F.col("t")).alias("a"), wire.tag_op(F.col("t")).alias("b")).collect()] == [True] * 4
