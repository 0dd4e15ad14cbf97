"""The data model: versioned records of a keyed table, and change logs over source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = "put", "delete"

#: One version of a key.  A delete has no value; an empty value with put is a value.
CHANGE = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


def changes(df: DataFrame, key: Column, seq: Column, delete: Column, value: Column) -> DataFrame:
    """A change log (key, seq, op, value) of the rows of a table."""
    return df.select(
        key.alias("key"),
        seq.cast("long").alias("seq"),
        F.when(delete, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"),
        F.when(~delete, value).alias("value"),
    )


def validated(log: DataFrame) -> DataFrame:
    """The log, failing at run time on a null key, a null or negative seq, or an unknown op; deletes lose their value."""
    bad = F.col("key").isNull() | F.col("seq").isNull() | (F.col("seq") < 0) | ~F.coalesce(F.col("op").isin(PUT, DELETE), F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit("a change needs a key, seq >= 0 and op put or delete"))).otherwise(F.col("seq"))
    return log.withColumn("seq", checked.cast("long")).withColumn("value", F.when(F.col("op") == PUT, F.col("value")))
