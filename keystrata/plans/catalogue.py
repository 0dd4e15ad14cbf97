"""The query catalogue over the driver's tables: Spark plans and their DuckDB equivalents.

Change log A is ``events``: key user_id, seq event_id, deleted by an error event.  Change
log B is ``lineitem``: key (l_orderkey, l_linenumber), seq l_shipdate, with ties.  Runs are
bands of 1000 event ids, layers bands of a third of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..model import CHANGE, changes
from ..operators import queues, runs, versions
from ..session import ship, work_dir
from ..sources import sst, wal, wire
from ..streaming.ingest import ingest
from ..streaming.telemetry import rates
from ..table import KVTable
from ..workload import levelled, puts

RUN, BANDS = 1000, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.col("event_type") == "error", F.col("value"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).withColumn("run_id", (F.floor(F.col("seq") / RUN) + 1).cast("long"))


A = "SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE WHEN event_type <> 'error' THEN value END AS value FROM events"
R = f"SELECT *, seq // {RUN} + 1 AS run_id FROM ({A})"
NEWEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Latest state and versions


@query(f"SELECT key, seq, value FROM ({A}) {NEWEST} AND op = 'put'")
def latest_state(spark, d):
    return versions.latest_state(event_log(spark, d)).select("key", "seq", "value")


LINE = ("l_orderkey", "l_linenumber")
LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in LINE_ORDER)}) = 1")
def latest_state_multicol(spark, d):
    best = versions.newest(table(spark, d, "lineitem"), list(LINE), [F.col(c).desc() for c in LINE_ORDER])
    return best.select(*LINE, "l_partkey", "l_suppkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"))


@query(f"SELECT key, seq, op, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC)::INT AS version FROM ({A})")
def version_scan(spark, d):
    return versions.version_scan(event_log(spark, d))


@query(f"SELECT key, seq, value FROM ({A}) WHERE seq <= 500 {NEWEST} AND op = 'put'")
def as_of(spark, d):
    return versions.as_of(event_log(spark, d), 500).select("key", "seq", "value")


@query(f"SELECT key, seq, value FROM ({A}) WHERE key >= 20 AND key < 60 {NEWEST} AND op = 'put'")
def range_scan(spark, d):
    return versions.range_scan(event_log(spark, d), 20, 60).select("key", "seq", "value")


# Reads


TRI = f"SELECT c_custkey AS key, CASE WHEN op IS NULL THEN 'absent' WHEN op = 'delete' THEN 'deleted' ELSE 'hit' END AS status, seq, value FROM customer LEFT JOIN (SELECT * FROM ({A}) {NEWEST}) ON key = c_custkey"


def _probes(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"))


@query(TRI)
def tri_state_get(spark, d):
    return versions.multi_get(_probes(spark, d), versions.newest(event_log(spark, d)))


@query(f"SELECT status, count(*) AS n FROM ({TRI}) GROUP BY status")
def multi_get_hits(spark, d):
    return tri_state_get(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT key, seq, op, value FROM ({A}) WHERE key = 42 {NEWEST}")
def point_get(spark, d):
    return versions.point_get(event_log(spark, d), 42)


LAYERS = f"SELECT *, {BANDS - 1} - least(seq * {BANDS} // (SELECT max(event_id) + 1 FROM events), {BANDS - 1}) AS layer FROM ({A})"


@query(f"SELECT key, seq, op, value, layer FROM ({LAYERS}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, seq DESC) = 1")
def layered_get(spark, d):
    log = event_log(spark, d)
    top = log.agg((F.max("seq") + 1).alias("top"))
    layer = F.lit(BANDS - 1) - F.least(F.floor(F.col("seq") * BANDS / F.col("top")), F.lit(BANDS - 1))
    layered = log.join(F.broadcast(top)).withColumn("layer", layer.cast("long")).drop("top")  # top: one row
    return versions.layered_get(layered)


@query("SELECT c_custkey AS key, (SELECT min(user_id) FROM events WHERE user_id >= c_custkey) AS bound FROM customer")
def lower_bound(spark, d):
    return versions.lower_bound(_probes(spark, d), event_log(spark, d).select("key"))


# Runs and compaction


@query(f"SELECT key, seq, op, value FROM ({R}) {NEWEST}")
def compact_keep(spark, d):
    return versions.merge_runs([event_runs(spark, d)], bottom=False).drop("run_id")


@query(f"SELECT key, seq, run_id, row_number() OVER (ORDER BY key, seq DESC) AS position FROM ({R})")
def merge_order(spark, d):
    """The order in which a merge reads all versions: by key, newest first; seq lies under 2**32 here."""
    place = F.col("key") * (1 << 32) - F.col("seq")
    return queues.fifo_batches(event_runs(spark, d).select("key", "seq", "run_id", place.alias("place")), F.col("place")).select("key", "seq", "run_id", "position")


@query(f"SELECT key, seq, op, value FROM ({R}) {NEWEST} AND op = 'put'")
def compact_drop(spark, d):
    return versions.merge_runs([event_runs(spark, d)], bottom=True).drop("run_id")


MINMAX = "SELECT run_id, min(key) AS min_key, max(key) AS max_key, count(*) AS rows, max(seq) AS max_seq FROM ({}) GROUP BY run_id"


@query(MINMAX.format(R))
def run_minmax(spark, d):
    return runs.run_minmax(event_runs(spark, d))


ORD = "SELECT o_custkey AS key, o_orderkey AS seq, o_custkey // 100 + 1 AS run_id FROM orders"
L0 = "SELECT min(min_key) AS lo, max(max_key) AS hi FROM ({}) WHERE run_id BETWEEN 3 AND 4".format(MINMAX.format(ORD))


def _order_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"))
    return o.withColumn("run_id", (F.floor(F.col("key") / 100) + 1).cast("long"))


@query(f"SELECT run_id, min_key, max_key, rows, max_seq FROM ({MINMAX.format(ORD)}), ({L0}) WHERE NOT (max_key < lo OR min_key > hi)")
def overlap_select(spark, d):
    r = runs.run_minmax(_order_runs(spark, d))
    return runs.overlap_select(r.where("run_id between 3 and 4"), r)


@query(f"SELECT run_id, min_key, max_key, rows, max_seq, (run_id - 1) // 4 AS compaction FROM ({MINMAX.format(R)})")
def l0_groups(spark, d):
    return runs.l0_groups(run_minmax(spark, d))


@query(f"SELECT c_custkey AS key, count(run_id) AS runs_touched FROM customer LEFT JOIN ({MINMAX.format(ORD)}) ON c_custkey BETWEEN min_key AND max_key GROUP BY c_custkey")
def run_pruning(spark, d):
    return runs.run_pruning(_probes(spark, d), runs.run_minmax(_order_runs(spark, d)))


SIZES = f"SELECT event_id // {RUN} + 1 AS run_id, event_id AS pos, 8 AS key_bytes, length(props) AS value_bytes FROM events"


def _entries(spark, d):
    e = table(spark, d, "events")
    return e.select((F.floor(F.col("event_id") / RUN) + 1).cast("long").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("key"), F.lit(8).alias("key_bytes"), F.length("props").alias("value_bytes"))


@query(f"SELECT run_id, CAST(sum(key_bytes + value_bytes + 16) AS BIGINT) AS physical, CAST(sum(key_bytes + value_bytes) AS BIGINT) AS logical, round(sum(key_bytes + value_bytes + 16) / sum(key_bytes + value_bytes), 6) AS amplification FROM ({SIZES}) GROUP BY run_id")
def write_amp(spark, d):
    return runs.write_amplification(_entries(spark, d))


FOLD = """
WITH RECURSIVE s AS (SELECT run_id, pos, key_bytes + value_bytes + {head} AS size, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rn FROM ({sizes})),
f AS (SELECT run_id, pos, size, rn, CAST(0 AS BIGINT) AS block_id, CAST(size AS BIGINT) AS used FROM s WHERE rn = 1
  UNION ALL SELECT s.run_id, s.pos, s.size, s.rn, f.block_id + CASE WHEN f.used >= {limit} THEN 1 ELSE 0 END, CASE WHEN f.used >= {limit} THEN 0 ELSE f.used END + s.size FROM f JOIN s ON s.run_id = f.run_id AND s.rn = f.rn + 1)
"""


@query(FOLD.format(head=16, sizes=SIZES, limit=4096) + "SELECT run_id, block_id, max(pos) AS last_key, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS entries FROM f GROUP BY run_id, block_id")
def sst_block_layout(spark, d):
    return runs.block_layout(_entries(spark, d).select("run_id", "pos", "key", (F.col("key_bytes") + F.col("value_bytes") + runs.ENTRY_HEADER).alias("size")))


@query(FOLD.format(head=24, sizes=SIZES, limit=16384) + "SELECT run_id, block_id, max(pos) AS freeze_seq, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY run_id, block_id")
def freeze_points(spark, d):
    e = _entries(spark, d).select("run_id", "pos", (F.col("key_bytes") + F.col("value_bytes") + runs.MEMTABLE_ENTRY).alias("size"))
    return runs.resetting_groups(e, "run_id", "pos", "size", 16384).groupBy("run_id", "block_id").agg(F.max("pos").alias("freeze_seq"), F.sum("size").alias("bytes"))


@query(f"SELECT max(seq) AS max_seq, run_id FROM ({R}) GROUP BY run_id")
def batch_max_seq(spark, d):
    return event_runs(spark, d).groupBy("run_id").agg(F.max("seq").alias("max_seq"))


SNAPS = (100, 400, 900)


@query(" UNION ALL ".join(f"SELECT key, seq, op, value, CAST({s} AS BIGINT) AS snapshot FROM ({A}) WHERE seq <= {s} {NEWEST}" for s in SNAPS))
def snapshot_retention(spark, d):
    return versions.snapshot_retention(event_log(spark, d), list(SNAPS))


def _binary_log(spark, d) -> DataFrame:
    text = lambda c: F.col(c).cast("string").cast("binary")
    return event_log(spark, d).select(text("key").alias("key"), "seq", "op", text("value").alias("value"))


@query(f"SELECT CAST(key AS VARCHAR) AS key, seq FROM ({A}) {NEWEST} AND op = 'put'")
def table_state(spark, d):
    """Five flushes into a keyed table, with the compaction that they trigger, then a scan of its newest version."""
    t, log = KVTable.open(spark, work_dir(spark)), _binary_log(spark, d)
    top = log.agg(F.max("seq")).first()[0] or 0
    for i in range(5):
        t.write(log.where((F.col("seq") > top * i // 5 - (i == 0)) & (F.col("seq") <= top * (i + 1) // 5)), batch_id=i)
    return t.scan().select(F.col("key").cast("string").alias("key"), "seq")


def _state(live: DataFrame) -> DataFrame:
    return live.select(F.col("key").cast("string").alias("key"), "seq")


@query(f"SELECT CAST(key AS VARCHAR) AS key, seq FROM ({A}) {NEWEST} AND op = 'put'")
def table_ingest(spark, d):
    """The change log as a stream of files, each a micro-batch, flushed into a keyed table."""
    root = work_dir(spark)
    _binary_log(spark, d).repartition(3).write.parquet(f"{root}/changes")
    t = KVTable.open(spark, f"{root}/table")
    ingest(spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{root}/changes"), t, f"{root}/checkpoint").awaitTermination()
    return _state(t.scan())


@query(f"SELECT CAST(key AS VARCHAR) AS key, seq FROM ({A}) {NEWEST} AND op = 'put' AND key % 7 <> 0")
def table_delete(spark, d):
    """Deletes of every seventh key, in a run of their own, hide what an older run holds."""
    t, log = KVTable.open(spark, work_dir(spark)), _binary_log(spark, d)
    t.write(log)
    top = log.agg(F.max("seq")).first()[0] or 0
    gone = log.where(F.col("key").cast("string").cast("long") % 7 == 0).select("key").distinct()
    t.write(gone.select("key", F.lit(top + 1).cast("long").alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("binary").alias("value")))
    return _state(t.scan())


@query(f"SELECT CAST(key AS VARCHAR) AS key, seq FROM ({A}) WHERE seq <= 500 {NEWEST} AND op = 'put'")
def table_pinned(spark, d):
    """A pinned version reads as before, after a later flush, a compaction and a vacuum that keeps it."""
    t, log = KVTable.open(spark, work_dir(spark)), _binary_log(spark, d)
    pinned = t.write(log.where("seq <= 500")).number
    t.write(log.where("seq > 500"))
    t.compact()
    t.vacuum({pinned})
    return _state(t.scan(pinned))


@query("SELECT 'hit' AS status, CAST(80000 AS BIGINT) AS n UNION ALL SELECT 'absent', 80000")
def engine_workload(spark, d):
    """Eight runs of 10,000 ordered keys with the compactions that they trigger, then look-ups of all keys and as many absent ones."""
    t = KVTable.open(spark, work_dir(spark))
    levelled(spark, t, 8)
    asked = puts(spark, 80_000).select("key").unionByName(puts(spark, 80_000, prefix="x_").select("key"))
    return t.multi_get(asked).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(key AS VARCHAR) AS key, seq, op, CASE WHEN op = 'put' THEN CAST(key AS VARCHAR) || '-' || CAST(seq AS VARCHAR) END AS value FROM ({A})")
def sst_codec(spark, d):
    """Every run written to the sorted table format and read back."""
    ship(spark)
    log = event_runs(spark, d).select("run_id", F.col("key").cast("string").alias("key"), "seq", "op")

    def round_trip(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k.encode(), None if op == "delete" else f"{k}-{s}".encode(), int(s)) for k, s, op in zip(pdf["key"], pdf["seq"], pdf["op"])]
        back = list(sst.SortedTable(sst.write(sorted(rows, key=lambda r: (r[0], -r[2])))))
        return pd.DataFrame([(k.decode(), s, "delete" if v is None else "put", None if v is None else v.decode()) for k, v, s in back], columns=["key", "seq", "op", "value"])

    return log.groupBy("run_id").applyInPandas(round_trip, "key string, seq long, op string, value string")


@query("SELECT 'k_' || lpad(CAST(range AS VARCHAR), 8, '0') AS key, range AS seq, 'put' AS op, 'v_' || lpad(CAST(range AS VARCHAR), 8, '0') AS value FROM range(10000)")
def gen_workload(spark, d):
    w = puts(spark, 10_000)
    return w.withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))


# Queue, map and routing


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS position, (row_number() OVER (ORDER BY event_id) - 1) // 16 AS batch_id FROM events")
def queue_fifo(spark, d):
    return queues.fifo_batches(table(spark, d, "events").select("event_id"), F.col("event_id"))


@query(f"SELECT key, seq, prior FROM (SELECT key, seq, op, lag(value) OVER (PARTITION BY key ORDER BY seq) AS prior FROM ({A})) WHERE op = 'delete'")
def map_remove_returns(spark, d):
    ops = event_log(spark, d).withColumn("op", F.when(F.col("op") == "put", "insert").otherwise("remove"))
    return versions.map_replay(ops).where("op = 'remove'").select("key", "seq", "prior")


@query(f"SELECT key, seq, op, CASE WHEN last = 'put' THEN prior END AS prior FROM (SELECT key, seq, op, lag(op) OVER w AS last, lag(value) OVER w AS prior FROM ({A}) WINDOW w AS (PARTITION BY key ORDER BY seq))")
def map_replay(spark, d):
    ops = event_log(spark, d).withColumn("op", F.when(F.col("op") == "put", "insert").otherwise("remove"))
    return versions.map_replay(ops).select("key", "seq", F.when(F.col("op") == "insert", "put").otherwise("delete").alias("op"), "prior")


GETS = f"SELECT key, seq, CASE WHEN seq % 5 = 0 THEN 'get' ELSE op END AS op, value FROM ({A})"


@query(f"SELECT key, seq, CASE WHEN last.op = 'put' THEN last.value END AS prior FROM (SELECT key, seq, op, last_value(CASE WHEN op <> 'get' THEN {{'op': op, 'value': value}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ({GETS})) WHERE op = 'get'")
def map_get(spark, d):
    """Every fifth event only reads its key."""
    op = F.when(F.col("seq") % 5 == 0, "get").when(F.col("op") == "put", "insert").otherwise("remove")
    return versions.map_replay(event_log(spark, d).withColumn("op", op)).where("op = 'get'").select("key", "seq", "prior")


@query("""
WITH RECURSIVE e AS (SELECT user_id AS queue, event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN 'push' ELSE 'pop' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT user_id AS queue, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST([] AS BIGINT[]) AS held, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS BIGINT) AS out FROM events GROUP BY user_id
  UNION ALL SELECT e.queue, e.rn, e.seq, e.op,
    CASE WHEN e.op = 'push' AND len(held) < 16 THEN list_append(held, e.seq) WHEN e.op = 'pop' THEN held[2:] ELSE held END,
    CASE WHEN e.op = 'push' THEN CASE WHEN len(held) < 16 THEN 'ok' ELSE 'full' END ELSE CASE WHEN len(held) > 0 THEN 'ok' ELSE 'empty' END END,
    CASE WHEN e.op = 'pop' THEN held[1] END
  FROM f JOIN e ON e.queue = f.queue AND e.rn = f.rn + 1)
SELECT queue, seq, op, result, out FROM f WHERE rn > 0
""")
def queue_replay(spark, d):
    """One bounded queue for each user: two events of three push, the third pops."""
    e = table(spark, d, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, "push").otherwise("pop").alias("op"), F.col("event_id").alias("item"))
    return queues.queue_replay(e, 16)


@query("SELECT user_id % 8 AS core, count(*) AS n FROM events GROUP BY 1")
def route_core(spark, d):
    return queues.route(table(spark, d, "events"), F.col("user_id"), 8).groupBy("core").agg(F.count("*").alias("n"))


@query("SELECT target, replica, count(*) AS n FROM (SELECT user_id % 8 AS target, false AS replica FROM events UNION ALL SELECT (user_id % 8 + 1) % 8, true FROM events) GROUP BY target, replica")
def replicate_ring(spark, d):
    routed = queues.route(table(spark, d, "events").select("user_id"), F.col("user_id"), 8)
    return queues.replicate(routed, 8).groupBy("target", "replica").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id % 8 AS core, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS seq FROM events")
def assign_seq(spark, d):
    routed = queues.route(table(spark, d, "events").select("event_id", "user_id"), F.col("user_id"), 8)
    return queues.assign_seq(routed, "core", F.col("event_id")).select("event_id", "core", "seq")


@query("SELECT event_id, core, seq, previous FROM (SELECT *, lag(seq) OVER (PARTITION BY core ORDER BY event_id) AS previous FROM (SELECT event_id, user_id % 8 AS core, event_id * 7919 % 10007 AS seq FROM events)) WHERE seq <= previous")
def seq_regression(spark, d):
    routed = queues.route(table(spark, d, "events").select("event_id", "user_id"), F.col("user_id"), 8)
    return queues.regressions(routed.withColumn("seq", F.col("event_id") * 7919 % 10007), "core", F.col("event_id")).select("event_id", "core", "seq", "previous")


# Codecs


@query("SELECT o_orderkey AS id, 'put' AS status, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS val FROM orders UNION ALL SELECT o_orderkey, 'get', CAST(o_orderkey AS VARCHAR), NULL FROM orders")
def wire_roundtrip(spark, d):
    o = table(spark, d, "orders")
    raw = F.concat(wire.encode_put(F.col("o_orderkey"), F.col("o_custkey")), wire.encode_get(F.col("o_orderkey")))
    f = wire.decode(wire.split_frames(o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"))))
    return f.select("id", "status", F.col("key").cast("string").alias("key"), F.col("val").cast("string").alias("val"))


@query("SELECT o_orderkey AS id, 'put' AS status, CAST(NULL AS VARCHAR) AS reply FROM orders UNION ALL SELECT o_orderkey, 'echo', 'PING' || o_orderkey FROM orders")
def wire_echo(spark, d):
    """What follows a request and is none itself comes back as it is."""
    raw = F.concat(wire.encode_put(F.col("o_orderkey"), F.col("o_custkey")), F.concat(F.lit("PING"), F.col("o_orderkey")).cast("binary"))
    f = wire.decode(wire.split_frames(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))))
    return f.select("id", "status", F.when(F.col("status") == "echo", F.col("frame").cast("string")).alias("reply"))


@query("SELECT event_id, ((event_id % 256) << 32) | ((user_id - 40) & 4294967295) AS tag, CAST(user_id - 40 AS INTEGER) AS fd, CAST(event_id % 256 AS INTEGER) AS op FROM events")
def tag_codec(spark, d):
    tagged = table(spark, d, "events").select("event_id", wire.tag(F.col("user_id") - 40, F.col("event_id") % 256).alias("tag"))
    return tagged.select("event_id", "tag", wire.tag_fd(F.col("tag")).alias("fd"), wire.tag_op(F.col("tag")).alias("op"))


@query("SELECT c_custkey AS key, seq, CAST(floor(value) AS BIGINT) AS reply FROM customer JOIN (SELECT * FROM (" + A + ") " + NEWEST + " AND op = 'put') ON key = c_custkey")
def wire_get(spark, d):
    state = versions.newest(event_log(spark, d)).withColumn("value", wire.be64(F.floor("value")))
    found = wire.replies(versions.multi_get(_probes(spark, d), state))
    return found.select("key", "seq", wire.u64(F.col("value")).cast("long").alias("reply"))


TORN = "QUALIFY run_id % 3 <> 0 OR row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) > 1"


@query(f"SELECT 'run-' || run_id AS path, seq + 1 AS wal_seq, CAST(key AS VARCHAR) AS key, seq, op, value FROM ({R}) {TORN}")
def wal_replay(spark, d):
    """Encode the event log as one log for each run, tear every third at its end, and replay the valid prefixes."""
    ship(spark)
    log = event_runs(spark, d).select("run_id", F.col("key").cast("string").cast("binary").alias("key"), "seq", "op", F.col("value").cast("string").cast("binary").alias("value"))
    frame = wal.encode(wal.change_payload(F.col("key"), F.col("seq"), F.col("op"), F.col("value")), F.col("seq") + 1)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        run = int(pdf["run_id"].iloc[0])
        data = wal.padded([bytes(x) for x in pdf.sort_values("seq")["frame"]])
        data = data.rstrip(b"\0")[:-5] if run % 3 == 0 else data
        return pd.DataFrame({"path": [f"run-{run}"], "content": [data]})

    files = log.select("run_id", "seq", frame.alias("frame")).groupBy("run_id").applyInPandas(gather, "path string, content binary")
    return wal.replay(files).select("path", "wal_seq", F.col("key").cast("string").alias("key"), "seq", "op", F.col("value").cast("string").cast("double").alias("value"))


@query(f"SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS wal_seq FROM ({R})")
def log_append(spark, d):
    """Each run's changes appended to a log in three goes: reopened, and torn and reopened, then read back."""
    ship(spark)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        payloads = [str(s).encode() for s in sorted(pdf["seq"])]
        a, b = len(payloads) // 3, 2 * len(payloads) // 3
        log, _ = wal.append(b"", payloads[:a])
        log, _ = wal.append(log, payloads[a:b])
        log, _ = wal.append(log + b"torn frame", payloads[b:])
        rows = [(int(pdf["run_id"].iloc[0]), int(r[4]), r[3]) for r in wal.scan(log) if r[5] == "ok"]
        return pd.DataFrame(rows, columns=["run_id", "seq", "wal_seq"])

    return event_runs(spark, d).select("run_id", "seq").groupBy("run_id").applyInPandas(write, "run_id long, seq long, wal_seq long")


@query(f"SELECT CAST(key AS VARCHAR) AS key, seq FROM ({A}) {NEWEST} AND op = 'put'")
def log_recover(spark, d):
    """Logs of every run, one of them torn behind its last frame, flushed into a new table, twice."""
    ship(spark)
    log = event_runs(spark, d).select("run_id", F.col("key").cast("string").cast("binary").alias("key"), "seq", "op", F.col("value").cast("string").cast("binary").alias("value"))
    frame = wal.encode(wal.change_payload(F.col("key"), F.col("seq"), F.col("op"), F.col("value")), F.col("seq") + 1)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        data = wal.padded([bytes(x) for x in pdf.sort_values("seq")["frame"]])
        return pd.DataFrame({"path": [f"run-{int(pdf['run_id'].iloc[0])}"], "content": [data + b"torn"]})

    files = log.select("run_id", "seq", frame.alias("frame")).groupBy("run_id").applyInPandas(gather, "path string, content binary")
    t = KVTable.open(spark, work_dir(spark))
    t.recover(files)
    t.recover(files)
    return t.scan().select(F.col("key").cast("string").alias("key"), "seq")


@query("SELECT event_id AS seq, 13 + length(CAST(user_id AS VARCHAR)) + CASE WHEN event_type <> 'error' THEN length(event_type) ELSE 0 END AS len, true AS crc_ok, 'ok' AS status FROM events")
def wal_frame_status(spark, d):
    """CRC of every change's frame, computed by Spark and checked by the decoder."""
    ship(spark)
    log = changes(table(spark, d, "events"), F.col("user_id"), F.col("event_id"), F.col("event_type") == "error", F.col("event_type"))
    body = wal.change_payload(F.col("key").cast("string").cast("binary"), F.col("seq"), F.col("op"), F.col("value").cast("binary"))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            first = [next(wal.scan(bytes(x))) for x in f["frame"]]
            yield pd.DataFrame({"seq": f["seq"], "len": [r[2] for r in first], "crc_ok": [r[1] == c for r, c in zip(first, f["crc"])], "status": [r[5] for r in first]})

    framed = log.select("seq", wal.encode(body, F.col("seq") + 1).alias("frame"))
    framed = framed.withColumn("crc", F.crc32(F.substring("frame", 5, 1 << 30)))
    return framed.mapInPandas(check, "seq long, len long, crc_ok boolean, status string")


# Telemetry


@query("SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS window_start, requests, rx_bytes, CAST(sum(requests) OVER (ORDER BY m) AS BIGINT) AS total_requests, requests - coalesce(lag(requests) OVER (ORDER BY m), 0) AS delta_requests FROM (SELECT date_trunc('minute', ts) AS m, count(*) AS requests, CAST(sum(length(props)) AS BIGINT) AS rx_bytes FROM events GROUP BY 1)")
def telemetry_rate(spark, d):
    r = rates(table(spark, d, "events"), F.col("ts"), F.length("props"), "1 minute")
    return r.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


# Bloom filters


def _bloom_probe(spark, d, prefix: str) -> DataFrame:
    """Filters of the customers' keys by partition of the key's CRC; probed by keys of the same partition."""
    ship(spark)
    own = table(spark, d, "customer").select(F.concat(F.lit("existing-"), F.col("c_custkey")).alias("key"))
    asked = table(spark, d, "customer").select(F.concat(F.lit(prefix), F.col("c_custkey")).alias("key"))
    part = lambda df: df.withColumn("p", F.pmod(F.crc32("key"), F.lit(4)))

    def probe(build: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        data = bloom.build([k.encode() for k in build["key"]])
        hits = bloom.contains(data, [k.encode() for k in ask["key"]]) if len(ask) else []
        return pd.DataFrame({"key": ask["key"], "hit": pd.Series(hits, dtype="bool")})

    return part(own).groupBy("p").cogroup(part(asked).groupBy("p")).applyInPandas(probe, "key string, hit boolean")


@query("SELECT count(*) AS n, count(*) AS hits FROM customer")
def bloom_no_false_neg(spark, d):
    return _bloom_probe(spark, d, "existing-").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query()
def bloom_fpr(spark, d):
    return _bloom_probe(spark, d, "missing-").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("fpr"))
