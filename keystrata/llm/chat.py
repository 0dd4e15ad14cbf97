"""Chat formatting: collapse cumulative snapshots of conversations, render what is left.

A log often holds a conversation again and again, one turn longer each time.  Every
row gets a rolling hash of its conversation up to that turn: the running XOR of two 64-bit
hashes of (position, role, text), 128 bits, computed by a window.  A whole conversation
whose hash is also that of an inner turn of another is a prefix of a longer one.  Equal whole
conversations collapse to the smallest conv_id first, so both sides of the anti-join have one
row for each hash, whatever the size of a group of copies.  Only what is left is gathered
and rendered.  Spark functions only.

Turns are in order of (turn, role, text), nulls first; repeated rows all count.  Null role
or text is the same as an empty one.  Rows whose conv_id is null form one conversation
with a null conv_id.  A conversation has no greatest length: its hashes are a stream that
spills, but its rendering is one string, so a task must be able to hold the longest conversation
that is kept.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, i, role, text, h1, h2, inner): turns with their position, prefix hash, and whether another turn follows."""
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    t = t.withColumn("i", F.row_number().over(w).cast("long")).withColumn("inner", F.lead(F.lit(True), 1, False).over(w))
    upto = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    for k in (1, 2):
        t = t.withColumn(f"h{k}", F.bit_xor(F.xxhash64(F.lit(k), "i", "role", "text")).over(upto))
    return t


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are no prefix of a longer one, one for each set of equal ones."""
    key = ["i", "h1", "h2"]
    whole = hashed.where("not inner").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inside = hashed.where("inner").select(*key).distinct()
    return whole.join(inside, key, "left_anti").select("conv_id", F.col("i").alias("n_turns"), "copies")


def render(role: F.Column, text: F.Column) -> F.Column:
    """One turn; a marker that occurs in a text is broken up so that it can't pass for a real one."""
    for marker in (TURN_START, TURN_END):
        text, role = (F.replace(c, F.lit(marker), F.lit(marker[:2] + " " + marker[2:])) for c in (text, role))
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END + "\n"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of every maximal conversation."""
    hashed = with_prefix_hashes(turns)
    kept = maximal(hashed)
    rows = hashed.select(F.col("conv_id").alias("c"), "i", render(F.col("role"), F.col("text")).alias("line"))
    joined = kept.join(rows, F.col("conv_id").eqNullSafe(F.col("c")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"])
    return joined.groupBy("conv_id", "n_turns", "copies").agg(F.array_join(lines, "").alias("rendered"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_OP10 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, i, n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS prefix,
    string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10)
      || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS rendered FROM t
), w AS (SELECT prefix, rendered, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE i = n GROUP BY prefix, rendered, n)
SELECT conv_id, n AS n_turns, copies, rendered FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE i < n)
"""
