import random

import pytest
from pyspark.sql import functions as F

from keystrata.model import CHANGE
from keystrata.streaming.ingest import ingest, live_latest, stateful_latest, stop
from keystrata.table import KVTable
from keystrata.workload import puts, wire_buffers


def scan(table, number=None):
    return {bytes(r["key"]): (r["seq"], bytes(r["value"])) for r in table.scan(number).collect()}


def test_against_a_dict(spark, tmp_path):
    rnd, t, want, seq = random.Random(1), KVTable.open(spark, f"file://{tmp_path}/t"), {}, 0
    for _ in range(9):
        rows = []
        for _ in range(30):
            seq += 1
            k = f"key{rnd.randrange(25)}".encode()
            v = None if rnd.random() < 0.3 else str(seq).encode()
            rows.append((k, seq, "delete" if v is None else "put", v))
            if v is None:
                want.pop(k, None)
            else:
                want[k] = (seq, v)
        t.write(spark.createDataFrame(rows, CHANGE))
        assert scan(t) == want
    assert scan(KVTable.open(spark, f"file://{tmp_path}/t")) == want
    levels = [r.level for r in t.manifest.read().runs]
    assert levels.count(1) == 1 and levels.count(0) < 4
    key = next(iter(want))
    assert t.get(key) == ("hit", *want[key]) and t.get(b"nothing")[0] == "absent"
    low, high = sorted(want)[2], sorted(want)[-2]
    assert {bytes(r["key"]) for r in t.scan(low=low, high=high).collect()} == {k for k in want if low <= k < high}


def test_snapshots_pins_and_vacuum(spark, tmp_path):
    t = KVTable.open(spark, f"file://{tmp_path}/t")
    v1 = t.put([(b"a", b"1", 1)]).number
    t.put([(b"a", b"2", 2)])
    t.delete([(b"a", 3)])
    assert scan(t, v1) == {b"a": (1, b"1")} and t.get(b"a")[0] == "deleted"
    t.compact()
    assert t.get(b"a")[0] == "absent"
    t.vacuum({v1})
    assert scan(t, v1) == {b"a": (1, b"1")} and scan(t) == {}
    with pytest.raises(RuntimeError):
        t.manifest.commit(t.manifest.read(v1), [], [])


def test_unpublished_run_is_ignored(spark, tmp_path):
    t = KVTable.open(spark, f"file://{tmp_path}/t")
    t.put([(b"a", b"1", 1)])
    t._run(spark.createDataFrame([(b"b", 2, "put", b"x")], CHANGE), 2, 0)  # a crash before publishing
    assert scan(KVTable.open(spark, f"file://{tmp_path}/t")) == {b"a": (1, b"1")}
    assert len(t.vacuum()) == 1


def test_deletes_stay_while_an_older_run_overlaps(spark, tmp_path):
    t = KVTable.open(spark, f"file://{tmp_path}/t")
    t.put([(b"a", b"1", 1), (b"m", b"1", 1)])
    t.compact()
    t.put([(b"p", b"1", 2), (b"z", b"1", 2)])
    t.compact()
    assert [r.level for r in t.manifest.read().runs] == [1, 1]
    t.delete([(b"b", 5)])
    t.put([(b"q", b"9", 6)])
    t.compact()
    assert scan(t) == {b"a": (1, b"1"), b"m": (1, b"1"), b"p": (2, b"1"), b"q": (6, b"9"), b"z": (2, b"1")}


def test_bad_changes_fail(spark, tmp_path):
    t = KVTable.open(spark, f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="a change needs"):
        t.write(spark.createDataFrame([(b"a", -1, "put", b"x")], CHANGE))
    assert t.write(spark.createDataFrame([], CHANGE)).runs == ()


def test_stream_restart_changes_nothing(spark, tmp_path):
    src, t = f"{tmp_path}/in", KVTable.open(spark, f"file://{tmp_path}/t")
    for i in range(5):
        puts(spark, 10, start=10 * i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):
        ingest(stream, t, f"{tmp_path}/cp").awaitTermination()
        assert t.scan().count() == 50
    puts(spark, 10, start=5).withColumn("seq", F.col("seq") + 1000).coalesce(1).write.mode("append").parquet(src)
    ingest(stream, t, f"{tmp_path}/cp").awaitTermination()
    assert t.scan().where("seq >= 1000").count() == 10 and t.scan().count() == 50


@pytest.mark.parametrize("operator", [live_latest, stateful_latest])
def test_live_latest(spark, tmp_path, operator):
    src = f"{tmp_path}/in"
    rows = [(b"a", 2, "put", b"2"), (b"a", 1, "put", b"1"), (b"b", 3, "put", b"3"), (b"b", 4, "delete", None)]
    for r in rows:
        spark.createDataFrame([r], CHANGE).coalesce(1).write.mode("append").parquet(src)
    name = f"live_{operator.__name__}"
    q = operator(spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table(name).collect():
        k = bytes(r["key"])
        last[k] = max(last.get(k, (0, "")), (r["seq"], r["op"]))
    assert last == {b"a": (2, "put"), b"b": (4, "delete")}


def test_wire_workload(spark):
    from keystrata.sources.wire import decode, split_frames

    rows = decode(split_frames(wire_buffers(spark))).collect()
    assert len(rows) == 64 and all(r["status"] == "put" and r["val"] == 2 * r["key"] for r in rows)


def test_stop_flushes_what_has_arrived(spark, tmp_path):
    puts(spark, 50).repartition(3).write.parquet(f"{tmp_path}/in")
    t = KVTable.open(spark, f"{tmp_path}/t")
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = ingest(stream, t, f"{tmp_path}/cp", processingTime="0 seconds")
    stop(query)
    assert not query.isActive and t.scan().count() == 50
    stop(query)
